import random

import numpy as np

from tessera.llm import packing


def plain_best_fit(sizes, length):
    """How full rows get when the best row is searched among all."""
    left, rows = [], []
    for p in sorted(range(len(sizes)), key=lambda p: -sizes[p]):
        fits = [(c, i) for i, c in enumerate(left) if c >= sizes[p]]
        i = min(fits)[1] if fits else len(left)
        if not fits:
            left.append(length)
            rows.append(0)
        left[i] -= sizes[p]
        rows[i] += sizes[p]
    return sorted(rows)


def test_rows_as_full_as_by_plain_search():
    rng = random.Random(7)
    for _ in range(200):
        length = rng.randint(1, 40)
        sizes = np.array([rng.randint(1, length) for _ in range(rng.randint(0, 70))], np.int64)
        rows = packing.best_fit_decreasing(sizes, length)
        assert sorted(p for r in rows for p in r) == list(range(len(sizes)))
        assert sorted(int(sizes[r].sum()) for r in rows) == plain_best_fit(sizes.tolist(), length)


def table(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "Wörter", "été", "42", "<|endoftext|>", "\n\n ", "😀"]) for _ in range(rng.choice([1, 5, 60, 700])))) for i in range(120)]
    return rows + [(500, None), (501, ""), (502, " " * 5000), (503, "word " * 60_000), (504, "x" * 250_000), (None, "no id")]


def test_round_trip_is_exact(spark):
    rows = table(spark)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int")
    packed = packing.packed(df, length=256).cache()
    back = {r.doc_id: r.text for r in packing.unpacked(packed, length=256).collect()}
    assert back == {i: t for i, t in rows if t}
    for r in packed.collect():
        ids = np.frombuffer(r.input_ids, "<u2")
        assert len(ids) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 256
        assert r.position_resets == r.cu_seqlens[:-1] and len(r.doc_ids) == len(r.doc_starts) == len(r.position_resets)
        assert all(a < b for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:])) and not ids[r.n_tokens :].any()
        at = packing.positions(r.cu_seqlens, 256)
        assert all(at[i] == 0 for i in r.position_resets) and at.max() < 256


def test_shards_and_stored_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 500)
    df = spark.createDataFrame([(i, "some words here " * (i % 9)) for i in range(90)], "doc_id long, text string").coalesce(1)
    packed = packing.packed(df, length=128)
    packing.write_packed(packed, str(tmp_path / "rows"))
    again = spark.read.parquet(str(tmp_path / "rows"))
    assert again.select("shard").distinct().count() > 1
    assert {r.doc_id: r.text for r in packing.unpacked(again, length=128).collect()} == {r.doc_id: r.text for r in df.collect() if r.text}


def plain_ids(text, pattern=packing.PATTERN):
    """Ids by the published library alone, on the whole text."""
    with open(packing.VOCABULARY, "rb") as f:
        return packing._encoding(f.read(), pattern).encode_ordinary(text)


def test_ids_are_those_of_the_whole_text(spark):
    rng = random.Random(5)
    texts = [
        "international" * 20_000, "".join(rng.choice("中文字符测试") for _ in range(250_000)), "x1'll!é " * 40_000, "a" * 100_001 + " b", " ".join("w" * rng.randint(1, 9) for _ in range(90_000)), "'" * 300_000, "a1" * 200_000,
        "word \n\n word's  \u3000x" * 20_000, "a" + " " * 60_000 + "b", "a" + "\n" * 70_000 + "b c", " " * 55_000, "x \t" * 90_000 + "y", "a" * 150_000 + "\n" + "b" * 150_000, "\x1c \x1d" * 80_000, "é" + "\x85" * 60_000 + " é",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {i: {} for i in range(len(texts))}
    for r in packing.packed(df, length=512).collect():
        ids = np.frombuffer(r.input_ids, "<u2")
        for k, (d, start) in enumerate(zip(r.doc_ids, r.doc_starts)):
            found[d][start] = ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()
    for i, text in enumerate(texts):
        assert [x for start in sorted(found[i]) for x in found[i][start]] == plain_ids(text), i


def test_white_space_that_the_plain_encoder_cannot_take(spark):
    text = "a" + " " * 3_000_000 + "b" + "\n" * 2_000_000
    back = packing.unpacked(packing.packed(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    assert back[0].text == text


def test_rows_without_text_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "one two", 3), (2, "one two", 3), (None, "three", 4)], "doc_id long, text string, row int").coalesce(1)
    (row,) = packing.packed(df, length=16).collect()
    assert sorted(row.doc_ids, key=str) == [2, 2, None] and row.n_tokens == 2 * len(plain_ids("one two")) + len(plain_ids("three"))


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_very_long_text_needs_little_besides_its_ids():
    import tracemalloc

    with open(packing.VOCABULARY, "rb") as f:
        data = f.read()
    encoding = packing._encoding(data, packing.PATTERN)
    text = "some words of a book. " * 500_000  # 11 MB
    encoding.encode_ordinary("warm up")
    tracemalloc.start()
    ids = packing.encode(text, encoding, None, "<u2")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids.dtype == np.uint16 and len(ids) > 2_500_000 and peak < 3 * ids.nbytes + (8 << 20)
    assert ids[:1000].tolist() == encoding.encode_ordinary(text[:20_000])[:1000]
