"""Reading the free-form metadata column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRING_MAP = T.MapType(T.StringType(), T.StringType())


def parse_metadata(value: Column) -> Column:
    """Metadata text to map<string,string>: JSON, else a Python dict literal, else empty.

    Exported rows may hold a dict literal: bare None/True/False words are turned
    into JSON words; single quotes are accepted by the JSON reader itself.
    """
    literal = value
    for word, json in (("None", "null"), ("True", "true"), ("False", "false")):
        literal = F.regexp_replace(literal, rf"([:,\[{{]\s*){word}(?=\s*[,}}\]])", f"$1{json}")
    as_json = F.from_json(value, _STRING_MAP, {"allowSingleQuotes": "false"})
    as_literal = F.from_json(literal, _STRING_MAP)
    return F.coalesce(as_json, as_literal, F.create_map().cast(_STRING_MAP))


def metadata_fields(df: DataFrame, names: list[str], column: str = "metadata") -> dict[str, Column]:
    """Columns for some metadata keys as strings, whatever the column's type is."""
    kind = df.schema[column].dataType
    source = F.col(column)
    if isinstance(kind, T.StructType):
        present = set(kind.fieldNames())
        return {
            n: (source[n].cast("string") if n in present else F.lit(None).cast("string"))
            for n in names
        }
    if isinstance(kind, T.MapType):
        return {n: F.try_element_at(source, F.lit(n)).cast("string") for n in names}
    return {n: F.get_json_object(source, f"$.{n}") for n in names}


def with_metadata(df: DataFrame, names: list[str], column: str = "metadata") -> DataFrame:
    """Add ``_m``: a struct of the named keys as strings, read with one JSON pass per row."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        return df.withColumn("_m", F.from_json(column, schema))
    fields = metadata_fields(df, names, column)
    return df.withColumn("_m", F.struct(*[c.alias(n) for n, c in fields.items()]))


def literal_metadata_to_json(column: Column) -> Column:
    """Rewrite metadata text of either kind as JSON text."""
    return F.to_json(parse_metadata(column))


def destination_port(column: Column) -> Column:
    """Port inside the nested connection category, '' when absent."""
    return F.coalesce(
        F.get_json_object(column, "$.Connection_Info.destination_port"), F.lit("")
    )
