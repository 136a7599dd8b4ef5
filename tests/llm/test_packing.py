import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from vigilog.llm.packing import WordIds, pack, pack_block, tokenizer_path, with_steps

ODD = ["", " ", "a<|endoftext|>b <|startoftext|> x", "it's DON'T 'S 12a3 don't!!!", "É İ ΑΣ ﬁ x ́y", "\x1c a\x85b 日本 語", "###*** a|b"]


def test_ids_are_the_tokenizers():
    tokenizer, words = Tokenizer.from_file(tokenizer_path()), WordIds(tokenizer_path())
    for text in [*ODD, *ODD]:
        (ids,) = words.ids([text.encode()])
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_blocks_lose_nothing_and_need_no_padding():
    r = random.Random(1)
    for n in (0, 1, 5, 400):
        sizes = [r.choice([1, 2, r.randrange(1, 300), r.randrange(1, 3000), r.randrange(1, 9000)]) for _ in range(n)]
        parts = defaultdict(list)
        for sequence in pack_block(sizes):
            total = sum(x[2] for x in sequence)
            assert total <= 2048 and total & (total - 1) == 0
            for doc, start, length in sequence:
                parts[doc].append((start, length))
        for doc, size in enumerate(sizes):
            at = 0
            for start, length in sorted(parts[doc]):
                assert start == at and length > 0
                at += length
            assert at == size


def test_pieces_round_trip(make, words):
    rows = [(i, words(i, 40 * i)) for i in range(40)] + [(50 + i, t) for i, t in enumerate(ODD)] + [(90, None), (None, "a b"), (3, words(3, 120))]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = with_steps(pack(make(rows, "start, tier, sequence_id"))).collect()
    wanted = defaultdict(int)
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        wanted[doc, len(ids)] += 1
        own = [p for p in got if p.doc_id == doc and p.doc_tokens == len(ids)]
        assert own
        for p in own:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for (doc, size), times in wanted.items():
        assert sum(p.length for p in got if p.doc_id == doc and p.doc_tokens == size) == size * times
    sequences = defaultdict(list)
    for p in got:
        sequences[p.sequence_id].append((p.offset, p.length, p.tier, p.step))
    for parts in sequences.values():
        at = 0
        for offset, length, tier, _ in sorted(parts):
            assert offset == at
            at += length
        assert at == parts[0][2] and len({x[2:] for x in parts}) == 1
    assert pack(make(rows).where("doc_id > 999")).collect() == []


def test_steps_of_a_tier_differ_by_one_sequence_at_most(spark):
    rows = [(t, (s % 5 << 36) + s, o) for t, n in ((2048, 1000), (256, 333)) for s in range(n) for o in (0, 100)]
    pieces = spark.createDataFrame([(t, s + t * 10**6, o) for t, s, o in rows], "tier int, sequence_id bigint, offset int")
    got = with_steps(pieces, 1 << 16).collect()
    assert len(got) == len(rows)
    for tier, n in ((2048, 1000), (256, 333)):
        steps = defaultdict(set)
        for x in got:
            if x.tier == tier:
                steps[x.step].add(x.sequence_id)
        sizes = [len(v) for v in steps.values()]
        assert len(sizes) == -(-n * tier // (1 << 16)) and sum(sizes) == n and max(sizes) - min(sizes) <= 1
