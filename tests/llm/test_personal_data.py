import hashlib
import random
import re

from vigilog.llm.personal_data import _luhn, base_spans, personal_data

FORMS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def _plain(text):
    found = []
    for kind, form in enumerate(FORMS):
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = (
                True,
                all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else False,
                16 <= len(digits) <= 19 and _luhn(digits),
                8 <= len(digits) <= 15,
            )[kind]
            if fits:
                found.append((kind, m.start(), m.end()))
    return found


def test_base_spans_agree_with_the_plain_forms():
    r = random.Random(5)
    parts = ["4111111111111111", " ", "-", "+1 (555) 123-4567", "a@b.co", ".", "12.3.4.255", "5", "@", "x@y.z@q.com.", "4111 1111 1111 1111", "é"]
    for _ in range(4000):
        text = "".join(r.choice(parts if r.random() < 0.7 else "aZ019.@+- ()%\n") for _ in range(r.randrange(14)))
        assert base_spans(text) == _plain(text), text
    assert base_spans("a" * 300000 + " @ " + "1" * 300000) == []


def test_patterns_find_what_the_forms_miss(make):
    rows = [(i, f"some words {i}. call me at +1 (212) 555-{1000 + i} soon") for i in range(30)]
    rows += [(100, "x call me at 212 555 7788 now"), (101, "the order 4455667788 came"), (102, None), (103, ""), (None, "mail a@b.co")]
    got = {x.doc_id: x for x in personal_data(make(rows, "base, found")).collect()}
    text = rows[30][1]
    assert [(s.kind, text[s.start : s.end]) for s in got[100].found] == [(3, "212 555 7788")] and got[100].base == []
    assert got[101].found == [] and got[102].found == [] and got[103].found == []
    assert [tuple(s) for s in got[None].base] == [(0, 5, 11)]
    assert all(len(got[i].base) == 1 and got[i].found == got[i].base for i in range(30))
    assert personal_data(make(rows).where("doc_id > 999")).collect() == []


def test_query_digests(spark, small):
    from vigilog.llm import queries

    texts = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for x in queries()["op8_personal_data"](spark, small).collect():
        spans = [f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for k, a, b in _plain(texts[x.doc_id])]
        assert x.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(x.spans.split(",")) and x.n_email == sum(s[:5] == "email" for s in spans)


def test_addresses_written_out_are_found_without_digit_or_sign(make):
    rows = [(i, f"please write to user{i}@example.com soon") for i in range(30)]
    rows += [(100, "please write to jane [at] example [dot] com soon"), (101, "please write to joe (AT) example.org")]
    got = {x.doc_id: x for x in personal_data(make(rows)).collect()}
    for i, want in ((100, "jane [at] example [dot] com"), (101, "joe (AT) example.org")):
        text = dict(rows)[i]
        assert [(s.kind, text[s.start : s.end]) for s in got[i].found] == [(0, want)]


def test_long_chains_of_patterns_are_followed_to_their_end(spark):
    from vigilog.llm.personal_data import pattern_scores

    rows = []
    for k in range(7):  # pattern k is trusted once pattern k - 1 made its eight values known
        rows += [(f"p{k}", f"known{i}", 3) for i in range(76)]
        rows += [(f"p{k}", f"new{k + j}-{i}", -1) for j in range(1 if k == 0 else 0, 2) for i in range(8)]
    said = spark.createDataFrame(rows, "pattern string, value string, kind int")
    assert {x.pattern for x in pattern_scores(said).collect()} == {f"p{k}" for k in range(7)}
