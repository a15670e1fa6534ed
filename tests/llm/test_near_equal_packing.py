import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import near_equal_packing as nep

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def plain_differencing(sizes, ways):
    """The method on tuples of all sums."""
    parts = [(s, [0] * (ways - 1) + [s]) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: -p[0])
        (_, a), (_, b) = parts[:2]
        both = sorted(x + y for x, y in zip(sorted(a), sorted(b, reverse=True)))
        both = [x - both[0] for x in both]
        parts = [(both[-1], both), *parts[2:]]
    return parts[0][1][-1] if parts else 0


def test_differencing_is_as_even_as_by_plain_tuples():
    rng = random.Random(5)
    for _ in range(200):
        ways = rng.randint(1, 9)
        sizes = rng.sample(range(1, 4000), rng.randint(1, 40))
        parts = nep.differencing(np.array(sizes, np.int64), ways)
        assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
        sums = [sum(sizes[i] for i in p) for p in parts] + [0] * (ways - len(parts))
        if len(sizes) > 2 * ways:
            assert max(sums) - min(sums) <= 2 * plain_differencing(sizes, ways) + max(sizes) // 4
    assert nep.differencing(np.zeros(0, np.int64), 3) == []


def test_sequences_hold_all_and_little_else():
    rng = random.Random(8)
    for n, top in ((0, 9), (1, 5), (1, 2047), (40, 2047), (400, 2047), (3000, 40), (7, 2047), (5000, 1)):
        pieces = [(d, 2048 * (d % 3), rng.randint(1, top)) for d in range(n)]
        found = nep.windows(pieces)
        spans = {}
        for s in found:
            size = sum(p[2] for p in s)
            assert 0 < size <= 2048
            for d, a, m in s:
                spans.setdefault(d, []).append((a, m))
        for d, start, m in pieces:
            at = start
            for a, k in sorted(spans.pop(d)):
                assert a == at and k > 0
                at += k
            assert at == start + m
        assert not spans
        sizes = [sum(p[2] for p in s) for s in found]
        assert sum(2048 - x for x in sizes if x & (x - 1)) <= sum(sizes) / 50


WORDS = ["the", "Wörter", "ÉTÉ", "42", "don't", "I'LL", "<|endoftext|>", "\n\n ", "😀!?", "x" * 90, "ſtraße", "İstanbul", "éa", "a b", "\x1c", "日本語", "naïve-ness", "'s's", "_a_", "ŉ", "ĸ", "﻿", "Ǆ", "<|x|>"]


def text(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", "", "\n", "\t "]) for _ in range(n))


def test_ids_are_those_of_the_whole_text(tokenizer, monkeypatch):
    rng = random.Random(3)
    data = open(PATH, "rb").read()
    encoder = nep.Encoder(data)
    assert encoder.by_words
    whole = lambda t: [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
    for t in [text(rng, rng.randrange(40)) for _ in range(500)] + ["", " ", "a", "x" * 300_000]:
        assert encoder.ids(t.encode()).tolist() == whole(t)
    monkeypatch.setattr(nep, "MOST_WORDS", 5)
    monkeypatch.setattr(nep, "PART_BYTES", 50)
    few = nep.Encoder(data)
    for t in [text(rng, 60) for _ in range(40)]:
        assert few.ids(t.encode()).tolist() == whole(t)
    few.by_words = False
    assert few.ids(text(random.Random(1), 30).encode()).tolist() == whole(text(random.Random(1), 30))


def test_pieces_cover_every_document(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(nep, "SHARD_TOKENS", 3000)
    rng = random.Random(6)
    rows = [(i, text(rng, rng.choice([1, 20, 200, 900]))) for i in range(90)] + [(500, None), (501, ""), (502, "long words " * 30_000), (None, "no id"), (600, "twice"), (600, "twice")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, length int, sequence_id string").repartition(3)
    packed = nep.packed(df, PATH).cache()
    found = packed.collect()
    whole = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows if i != 600}
    by_doc = {}
    for r in found:
        assert len(r.ids) == 4 * r.length
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, ids in whole.items():
        parts = sorted(by_doc[i], key=lambda r: r.start)
        assert [r.start for r in parts] == np.cumsum([0, *(r.length for r in parts)])[:-1].tolist()
        assert b"".join(r.ids for r in parts) == np.array(ids, "<u4").tobytes() and {r.doc_tokens for r in parts} == {len(ids)}
    assert sum(r.length for r in by_doc[600]) == 2 * by_doc[600][0].doc_tokens
    sequences = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) == 2048
    assert sum(2048 - x for x in sequences.values() if x & (x - 1)) <= sum(sequences.values()) / 50
    for r in nep.sequences(packed).collect():
        ids = np.frombuffer(r.input_ids, "<u4")
        assert len(ids) == r.padded == (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else 2048) and not ids[r.n_tokens :].any()
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens == sequences[r.sequence_id]
        mine = sorted((p for p in found if p.sequence_id == r.sequence_id), key=lambda p: p.offset)
        assert [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:])] == [zlib.crc32(p.ids) for p in mine]


def test_no_rows(spark):
    assert nep.packed(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
