import random

from tokenizers import Tokenizer, models, normalizers

from vigilog.llm.token_counts import Counter, token_counts, vocabulary, vocabulary_path


def test_counts_are_those_of_the_unigram_model(make):
    pieces = vocabulary(vocabulary_path())
    model = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    model.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    r = random.Random(2)
    texts = ["".join(r.choice("ab the\n  é☃x▁\t1日\x00ing") for _ in range(r.randrange(1, 40))) for _ in range(400)]
    texts += ["", " ", "  ", "\n", "\nhello", " \n", "a\n", "<0x41> x", "the " * 3000, "antidisestablishment " * 20]
    got = {x.doc_id: x.n_tokens for x in token_counts(make([*enumerate(texts), (900, None), (None, "a")], "n_tokens")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == len(model.encode(text, add_special_tokens=False).ids), repr(text)
    assert got[900] == 0 and got[None] == got.get(None) > 0
    assert token_counts(make([(1, "a")]).where("doc_id > 1")).collect() == []


def test_ties_keep_the_piece_that_starts_first():
    pieces = [("<unk>", 0.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("▁", -1.0)]
    model = Tokenizer(models.Unigram(pieces, unk_id=0))
    for n in range(1, 12):
        assert Counter(pieces).of_word("a" * n) == len(model.encode("a" * n).ids)
