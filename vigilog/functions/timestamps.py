"""Instants from the text forms that log sources write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOCK = r"\d{1,2}:\d{1,2}:\d{1,2}"
_OFFSET = r"[+-]\d{2}:?\d{2}"

# Fixed patterns: how each form is recognised.
FORMS = {
    "iso": rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}T{_CLOCK}(\.\d{{1,6}})?(Z|{_OFFSET})?$",
    "plain": rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}\s+{_CLOCK}(\.\d{{1,6}})?(\s+(UTC|GMT))?$",
    "web": rf"^\d{{1,2}}/[A-Za-z]{{3}}/\d{{4}}:{_CLOCK}\s+({_OFFSET}|Z)$",
    "syslog": rf"^[A-Za-z]{{3}}\s+\d{{1,2}}\s+{_CLOCK}$",
}


def _convert(form: str, text: Column, year: Column) -> Column:
    utc = F.lit("+00:00")
    if form == "iso":
        zoned = F.regexp_like(text, F.lit(rf"(Z|{_OFFSET})$"))
        return F.when(zoned, text).otherwise(F.concat(text, utc)).try_cast("timestamp")
    single = F.regexp_replace(text, r"\s+", " ")
    if form == "plain":
        bare = F.regexp_replace(single, " (UTC|GMT)$", "")
        return F.concat(bare, utc).try_cast("timestamp")
    if form == "web":
        compact = F.regexp_replace(single, r":(\d{2})$", "$1")
        stamp = F.when(F.endswith(single, F.lit("Z")), single).otherwise(
            F.when(F.regexp_like(single, F.lit(r"[+-]\d{2}:\d{2}$")), compact).otherwise(single)
        )
        return F.try_to_timestamp(stamp, F.lit("d/MMM/yyyy:H:m:s XX"))
    return F.try_to_timestamp(
        F.concat(year, F.lit(" "), single, F.lit(" +0000")), F.lit("yyyy MMM d H:m:s XX")
    )


def parse_ts(text: Column, reference_year: int | Column, likely: str = "iso") -> Column:
    """The instant a timestamp text names; no zone means UTC; NULL if no form fits.

    ``reference_year`` supplies the year that syslog lines leave out. Each form
    is recognised by its shape first, the ``likely`` one before the others, so
    that only one conversion runs per row.
    """
    year = F.lit(reference_year).cast("string")
    result = F.lit(None).cast("timestamp")
    for form in sorted(FORMS, key=lambda f: f == likely):
        fits = F.regexp_like(text, F.lit(FORMS[form]))
        result = F.when(fits, _convert(form, text, year)).otherwise(result)
    return result
