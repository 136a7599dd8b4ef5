import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, in several partitions; other columns may be named."""

    def docs(rows, extra: str = ""):
        full = [(i, t, "en", "src0", len(t) if t is not None else None, *(["x"] * len(extra.split(", ")) if extra else [])) for i, t in rows]
        schema = SCHEMA + (", " + ", ".join(f"`{c}` string" for c in extra.split(", ")) if extra else "")
        return spark.createDataFrame(full, schema).repartition(3)

    return docs


@pytest.fixture(scope="session")
def words():
    """Seeded invented text of a given number of words."""
    import random

    def text(seed: int, n: int, vocabulary: int = 4900) -> str:
        r = random.Random(seed)
        numbers = (r.randrange(vocabulary) for _ in range(n))
        return " ".join("w" + "".join(chr(97 + (k // 17**i) % 17) for i in range(3)) for k in numbers)

    return text
