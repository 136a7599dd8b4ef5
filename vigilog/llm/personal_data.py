"""Personal data: exact base spans, and further ones found by bootstrapped context patterns.

Base spans seed a graph of patterns (the words before a mention) and instances (the values
mentioned). Patterns are scored by the known instances of a kind among all values that they
introduce, instances by the patterns that introduce them; what scores high becomes known and
the scores are taken again. Mentions that a high-scoring pattern introduces are spans of its kind.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Registry, documents, map_rows, staged, text_bytes

ops = Registry()

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 8  # known values at least that a pattern must have introduced
TRUST = 0.9  # share of a pattern's values, and score of an instance, from which they count

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(rb"[0-9@]|[\[(]at[\])]", re.I)  # what every base form and every form of _LIKE needs
_LIKE = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|@)[\])]\x20?[A-Za-z0-9-]{1,64}(?:\x20?(?:\.|[\[(](?:dot|\.)[\])])\x20?[A-Za-z0-9-]{1,64})+"
    r"|\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){5,}"
    r"|(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])[A-Za-z0-9]{6,}(?:[_-][A-Za-z0-9]+)*",
    re.I,
)
_CLASS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, leftmost and not overlapping within a kind."""
    found: list[tuple[int, int, int]] = []
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _CLASS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((0, start, domain.end()))
            last = domain.end()
        # An address can start anew only behind this sign, so the walk back stops there.
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((3, m.start(), m.end()))
    return found


def _pattern(text: str, start: int) -> str:
    """The two words before a place, without digits and marks at their ends."""
    words = text[max(0, start - 80) : start].lower().split()
    if start > 80 and words and not text[start - 81].isspace():
        words = words[1:]
    words = [re.sub(r"[0-9]", "0", w.strip("\"'([{<*#$%&!?.,;|")) for w in words[-2:]]
    return " ".join(w for w in words if w)


_ROW = (
    "doc_id bigint, base array<struct<kind:int,start:int,end:int>>, "
    "mentions array<struct<start:int,end:int,value:string,pattern:string,kind:int>>"
)


def mentions(docs: DataFrame) -> DataFrame:
    """Per row its base spans, and all mentions: base spans and other values that look like identifiers."""

    def make() -> Callable:
        def of(text: bytes) -> tuple[list, list]:
            if not _ANY.search(text):
                return [], []
            s = text.decode("utf-8", "replace")
            base = base_spans(s)
            taken = sorted((a, b) for _, a, b in base)
            said = [{"start": a, "end": b, "value": s[a:b].lower(), "pattern": _pattern(s, a), "kind": k} for k, a, b in base]
            i = 0
            for m in _LIKE.finditer(s):
                while i < len(taken) and taken[i][1] <= m.start():
                    i += 1
                near = [t for t in taken[max(0, i - 4) : i + 4] if t[0] < m.end() and m.start() < t[1]]
                if not near:
                    said.append({"start": m.start(), "end": m.end(), "value": m[0].lower(), "pattern": _pattern(s, m.start()), "kind": -1})
            return [{"kind": k, "start": a, "end": b} for k, a, b in base], said

        def work(rows: dict[str, list]) -> dict[str, list]:
            found = [of(t) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "base": [b for b, _ in found], "mentions": [m for _, m in found]}

        return work

    return map_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text")), make, _ROW)


def pattern_scores(said: DataFrame, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """(pattern, kind, score) of the patterns to trust, from mentions (pattern, value, kind).

    A value that became known keeps its kind, so known values and trusted patterns only grow, and
    the rounds end when no value is new.
    """
    edges = said.where("pattern <> ''").groupBy("pattern", "value").agg(F.max("kind").alias("kind"))
    edges = staged(edges, "edges")
    known = staged(edges.where("kind >= 0").groupBy("value").agg(F.max("kind").alias("kind")), "known")
    totals = staged(edges.groupBy("pattern").agg(F.count("*").alias("values")), "totals")
    rounds = 0
    while True:
        hits = edges.drop("kind").join(known, "value").groupBy("pattern", "kind").agg(F.count("*").alias("hits"))
        scores = hits.join(totals, "pattern").withColumn("score", F.col("hits") / F.col("values"))
        trusted = staged(scores.where((F.col("hits") >= support) & (F.col("score") >= trust)).select("pattern", "kind", "score"), "trusted")
        # An instance that trusted patterns introduce: chance that not all of them err.
        doubt = F.exp(F.sum(F.log(1 - F.least(F.col("score"), F.lit(0.999)))))
        new = edges.where("kind < 0").drop("kind").join(trusted, "pattern").groupBy("value", "kind").agg((1 - doubt).alias("score"))
        new = new.where(F.col("score") >= trust).groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
        new = staged(new.join(known, "value", "left_anti"), "new")
        if not new.count():
            return trusted
        known = known.unionByName(new)
        rounds += 1
        if rounds % 16 == 0:  # keeps the plan short
            known = staged(known, "known")


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint")


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(F.sort_array(spans), one), ",")


def personal_data(docs: DataFrame, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """Per row of ``docs``: doc_id, ``base`` and ``found`` spans (kind, start, end), in code points.

    Null text is empty and has none; ids are carried, nulls too; each row is looked at by itself, so
    repeated rows get equal spans, but their values count once for a pattern. ``found`` has the
    base spans and those of trusted patterns, which overlap no base span. Other columns don't matter.
    """
    rows = staged(mentions(docs).withColumn("uid", F.monotonically_increasing_id()), "mentions")
    each = rows.select("uid", F.explode("mentions").alias("m")).select("uid", "m.*")
    trusted = pattern_scores(each, support, trust)
    best = trusted.groupBy("pattern").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("as"))
    more = each.where("kind < 0").join(best, "pattern").groupBy("uid").agg(
        F.collect_list(F.struct(F.col("as").alias("kind"), "start", "end")).alias("more")
    )
    empty = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return rows.join(more, "uid", "left").select(
        "doc_id", "base", F.concat("base", F.coalesce("more", empty)).alias("found")
    )


@ops.add()
def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data(documents(spark, folder))
    counts = [_count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("found").alias("spans"))
