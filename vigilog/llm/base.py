"""Helpers shared by the operators: reading tables, staging results, Arrow maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

from vigilog.session import work_folder

BATCH_BYTES = 8 << 20
BROADCAST_BYTES = 40 << 20
TABLE_BYTES = 64  # of a row in a hash table, for its place


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a short plan that survives lost executors."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_texts(df: DataFrame, name: str) -> DataFrame:
    """As ``staged``, for tables that hold texts: packed closer."""
    path = work_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_bytes(rows: DataFrame) -> Column:
    """About the bytes that the rows take in the table that Spark sends to all executors, summed: their values, 8 for
    each column and what the table itself needs. Null if there are none."""

    def beyond(value: Column, kind: DataType) -> Column:
        """Of a value, besides the 8 of its column."""
        if isinstance(kind, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint")
        if isinstance(kind, StructType):
            return sum((8 + beyond(value.getField(f.name), f.dataType) for f in kind.fields), F.lit(8).cast("bigint"))
        if isinstance(kind, MapType):
            return beyond(F.map_keys(value), ArrayType(kind.keyType)) + beyond(F.map_values(value), ArrayType(kind.valueType))
        if isinstance(kind, ArrayType):
            size = 16 + 8 * F.greatest(F.size(value), F.lit(0)).cast("bigint")
            if not isinstance(kind.elementType, (StringType, BinaryType, StructType, MapType, ArrayType)):
                return size
            rest = F.aggregate(value, F.lit(0).cast("bigint"), lambda total, x: total + beyond(x, kind.elementType))
            return size + F.coalesce(rest, F.lit(0).cast("bigint"))
        return F.lit(0).cast("bigint")

    each = F.lit(8 + TABLE_BYTES).cast("bigint")
    return F.sum(sum((8 + beyond(F.col(f"`{f.name}`"), f.dataType) for f in rows.schema.fields), each))


def join_small(rows: DataFrame, keys: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join wide rows with a staged table: sent to all executors up to ``BROADCAST_BYTES``, so that the wide rows stay
    where they are, and shuffled beyond.

    The driver builds what is sent and holds it two or three times, so its bytes count, however many rows they are. Spark
    is not left to send more on its own account: it goes by the size of the packed files.
    """
    small = (keys.agg(row_bytes(keys)).first()[0] or 0) <= BROADCAST_BYTES
    return rows.join(F.broadcast(keys) if small else keys.hint("merge"), on, how)


def text_bytes(column: str = "text"):
    """A text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """Map column lists to column lists inside the tasks, a few MB of rows at a time.

    ``make`` runs once per task and returns the function that maps a slice; Arrow
    batches are cut so that one with long texts isn't turned into objects at once.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            start, n = 0, batch.num_rows
            step = max(1, n if not n else int(n * BATCH_BYTES / max(batch.nbytes, BATCH_BYTES)))
            while start < n:
                part = batch.slice(start, step)
                found = work(dict(zip(part.schema.names, (c.to_pylist() for c in part.columns))))
                columns = [pa.array(found[f.name], type=f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
                start += step

    return df.mapInArrow(run, out)


class Registry:
    """Queries of the operators and the SQL they must agree with."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def register(query):
            self.queries[query.__name__] = query
            if sql is not None:
                self.oracles[query.__name__] = sql
            return query

        return register
