"""Words and hashes against plain Python, whatever the blocks that they are computed in."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import kernel

PLAIN = {"space_words": r"[^\x20\x09-\x0D]+", "alnum_words": r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"}


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.mark.parametrize("block", [7, 64, 1 << 18])
@pytest.mark.parametrize("name", PLAIN)
def test_words_as_by_regular_expression(monkeypatch, block, name):
    monkeypatch.setattr(kernel, "SLICE_BYTES", block)
    kernel._powers.cache_clear()
    rng, seen, heads = random.Random(block), {}, {}
    for _ in range(150):
        rows = ["".join(rng.choice("abAB  \n.é中9") for _ in range(rng.randint(0, 50))) or None for _ in range(rng.randint(0, 9))]
        raw, at, _ = kernel.string_buffers(pa.array(rows, pa.string()))
        words = kernel.Words(raw, at, getattr(kernel, name)(), prefix=3)
        for i, text in enumerate(rows):
            own = range(words.at[i], words.at[i + 1])
            found = [raw[at[0] + words.start[j] : at[0] + words.end[j]].tobytes().decode() for j in own]
            if name == "alnum_words":  # capitals separate nothing, but are of the small letters' value
                assert [low(w) for w in found] == re.findall(PLAIN[name], low(text or ""))
            else:
                assert found == re.findall(PLAIN[name], text or "")
            for j, w in zip(own, found):
                assert seen.setdefault(low(w), words.hash[j]) == words.hash[j]
                assert heads.setdefault(low(w).encode()[:3], words.head[j]) == words.head[j]
    assert len(set(seen.values())) == len(seen) and len(set(heads.values())) == len(heads)
    kernel._powers.cache_clear()


def test_one_very_long_word_and_spans(monkeypatch):
    text = "中a" * 700_000
    raw, at, _ = kernel.string_buffers(pa.array([text, "x " + text + " y", text[:-1]], pa.large_string()))
    words = kernel.Words(raw, at, kernel.space_words())
    assert len(words.hash) == 5 and words.hash[0] == words.hash[2] != words.hash[4]
    monkeypatch.setattr(kernel, "SLICE_BYTES", 10)
    kernel._powers.cache_clear()
    values = np.array([3, 5, 7, 11] * 9, np.uint64)
    h = kernel.span_hashes(values, np.array([0, 4, 1, 17]), np.array([15, 19, 16, 32]))
    assert h[0] == h[1] and h[2] == h[3] != h[0]
    kernel._powers.cache_clear()


def test_more_cuts():
    raw, at, _ = kernel.string_buffers(pa.array(["ab cd", "efgh"], pa.large_string()))
    words = kernel.Words(raw, at, kernel.space_words(), cuts=np.array([1, 7]))
    assert [(s, e) for s, e in zip(words.start.tolist(), words.end.tolist())] == [(0, 1), (1, 2), (3, 5), (5, 7), (7, 9)] and words.at.tolist() == [0, 3, 5]
