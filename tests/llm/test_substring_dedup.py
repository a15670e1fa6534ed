import hashlib
import random
import re

import pyarrow as pa
import pytest

from tessera.llm import kernel, queries, substring_dedup


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() + (rng.choice([".", "!", ",", ".\n"]) if rng.random() < 0.1 else "") for _ in range(n))
    unbroken = " | ".join(word() for _ in range(30))
    passages = [prose(55), " ".join(word() for _ in range(60)), unbroken, prose(300)]
    docs, holders = [], {}
    for i in range(80):
        text = [prose(rng.choice([0, 3, 40, 200]))]
        if i % 4 == 0:
            p = rng.randrange(len(passages))
            text = [*text, passages[p], prose(rng.choice([0, 60]))]
            holders.setdefault(p, []).append(i)
        docs.append((i, rng.choice([" ", "\n"]).join(text)))
    return docs, passages, holders


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")
    return substring_dedup.repeated_spans(df).collect()


def test_repeated_passages_are_found_and_nothing_else(spark):
    docs, _, holders = corpus()
    got = found(spark, docs)
    assert {r.doc_id for r in got} == {i for ids in holders.values() for i in ids[1:]}


def test_what_repeats_goes_and_the_rest_stays(spark):
    docs, passages, holders = corpus(2)
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, extra string")
    left = substring_dedup.without_repeats(df, substring_dedup.repeated_spans(df))
    assert left.schema == df.schema
    after, before = {r.doc_id: r.text for r in left.collect()}, dict(docs)
    later = {i: p for p, ids in holders.items() for i in ids[1:]}
    for i, text in before.items():
        if i not in later:
            assert after[i] == text
        else:
            gone = len(text.split()) - len(after[i].split())
            assert 0.5 * len(passages[later[i]].split()) <= gone <= len(passages[later[i]].split()) + 16


def test_copies_nulls_ties_and_empty(spark):
    docs, _, _ = corpus(3)
    long = docs[1][1] + " " + " ".join(f"u{i}" for i in range(100))
    got = found(spark, [(3, long), (2, long), (2, long), (5, None), (6, ""), (None, long), (7, "too short to be a run of words")])
    assert [(r.doc_id, r.first_word, r.n_words) for r in got] == [(3, 0, len(long.split()))]
    twice = found(spark, [(1, long + "\n" + long)])
    n = len(long.split())
    assert len(twice) == 1 and abs(twice[0].first_word - n) <= 30 and twice[0].first_word + twice[0].n_words == 2 * n
    assert found(spark, []) == []


@pytest.mark.parametrize("n", [150_000])
def test_very_long_text(spark, n):
    text = " ".join(f"x{i}" for i in range(n))
    got = found(spark, [(1, text), (2, "a b c " + text)])
    assert [r.doc_id for r in got] == [2] and got[0].n_words > n - 20


def test_a_word_said_again_and_again(spark):
    docs, _, _ = corpus(4)
    rows = [(100, docs[1][1] + " " + "and " * 70), (101, docs[2][1] + " " + "and " * 64 + docs[3][1]), (102, docs[5][1] + " " + "buy it now " * 30), (103, "buy it now " * 25 + docs[6][1])]
    words = {i: t.split() for i, t in rows}
    covered = {i: sum(r.n_words for r in found(spark, rows) if r.doc_id == i) for i in words}
    assert covered[101] >= 60 and covered[103] >= 70 and covered[100] < 70 and covered[102] < 85


def test_neighbours_and_layout_do_not_matter(spark):
    docs, _, _ = corpus(5)
    texts = [t for _, t in docs]

    def cut(rows):
        raw, at, _ = kernel.string_buffers(pa.array(rows))
        words = substring_dedup._words(raw, at)
        return [[x[a:b].tolist() for x in substring_dedup.borders(raw, words, 0)] for a, b in zip(words.at[:-1], words.at[1:])]

    alone = [cut([t])[0] for t in texts]
    assert cut(texts) == alone and cut(texts[::-1]) == alone[::-1]

    def results(rows, parts):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        spans = substring_dedup.repeated_spans(df)
        return sorted(map(tuple, spans.collect())), sorted(map(tuple, substring_dedup.without_repeats(df, spans).collect()))

    first = results(docs, 1)
    assert first[0] and results(docs[::-1], 1) == first and results(random.Random(1).sample(docs, len(docs)), 7) == first


def plain_sentence_runs(docs, least_words, least=3):
    """Spans by strings: every shortest run of sentences that is long enough and not the first of its kind."""
    heads, runs = {}, []
    for i, text in sorted((i, t) for i, t in docs if i is not None and t):
        ends = [m.start() for m in re.finditer(r"(?<=[.!?])[\"')\]}]?(?=\s)|\n", text)]
        sentences, at = [], 0
        for e in [*ends, len(text)]:
            n = len(text[:e].split()) if e == len(text) or text[e] == "\n" else len(text[: e + 1].split())
            if n > at:
                sentences.append((at, n))
                at = n
        words = text.split()
        for k in range(len(sentences)):
            for m in range(k + least - 1, len(sentences)):
                a, b = sentences[k][0], sentences[m][1]
                if b - a >= least_words:
                    heads.setdefault(tuple(words[a:b]), (i, a))
                    runs.append((i, a, b, tuple(words[a:b])))
                    break
    out = []
    for i, a, b, key in sorted((r for r in runs if heads[r[3]] != (r[0], r[1])), key=lambda r: r[:3]):
        if out and out[-1][0] == i and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([i, a, b])
    return sorted((i, a, b - a) for i, a, b in out)


@pytest.mark.parametrize("stretch", [1, 200, 1 << 20])
def test_runs_of_sentences_as_by_strings(spark, monkeypatch, stretch):
    monkeypatch.setattr(substring_dedup, "STRETCH_WORDS", stretch)
    monkeypatch.setattr(kernel, "SLICE_BYTES", 2000)
    rng = random.Random(9)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) + rng.choice([".", "!", "?", '."', "\n"]) for _ in range(25)]
    docs = [(rng.randrange(10_000), " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for _ in range(60)]
    docs = list(dict(docs).items()) + [(None, pool[0] * 9), (20_000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for least in (1, 24):
        got = substring_dedup.repeated_spans(df, min_words=1 << 30, sentence_words=least)
        assert sorted(map(tuple, got.collect())) == plain_sentence_runs(docs, least)


def test_five_short_sentences_and_wide_stops(spark):
    docs, _, _ = corpus(7)
    rng = random.Random(2)
    five = " ".join(" ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(5)) + "." for _ in range(5))
    wide = "".join("".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(9)) + rng.choice("。！？") for _ in range(4))
    rows = [(1, "One two. " + five + " Three four."), (2, "Five. " + five + " Six."), (3, "甲乙。" + wide + "丙丁。"), (4, "戊。" + wide + "己"), (5, docs[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = substring_dedup.repeated_spans(df, min_words=1 << 30)
    assert {r.doc_id: r.n_words for r in spans.collect()} == {2: 25, 4: 40}
    left = dict(map(tuple, substring_dedup.without_repeats(df, spans).collect()))
    assert left[2] == "Five. Six." and left[4] == "戊。己" and left[1] == rows[0][1]


def test_clashing_columns(spark):
    docs, _, _ = corpus(8)
    df = spark.createDataFrame([(*r, 1, 2, "z", 3) for r in docs], "doc_id long, text string, __id int, __cuts int, h string, spans int")
    spans = substring_dedup.repeated_spans(df)
    left = substring_dedup.without_repeats(df, spans)
    assert left.schema == df.schema and left.count() == len(docs)
    plain = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, left.select("doc_id", "text").collect())) == sorted(map(tuple, substring_dedup.without_repeats(plain, spans).collect()))


def test_the_query_cuts_the_texts_of_all_documents(spark, tmp_path):
    docs, _, holders = corpus(6)
    df = spark.createDataFrame([*docs, (500, None), (None, docs[0][1])], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op8_substring_dedup(spark, str(tmp_path)).collect()}
    spans = substring_dedup.repeated_spans(df)
    left = {r.doc_id: r.text for r in substring_dedup.without_repeats(df, spans).collect()}
    assert set(got) == {*dict(docs), 500, None} and {i for i, r in got.items() if r.spans} == {i for ids in holders.values() for i in ids[1:]}
    for i, text in left.items():
        assert got[i].n_chars == (None if text is None else len(text))
        assert got[i].text_sha256 == (None if text is None else hashlib.sha256(text.encode()).hexdigest())
    assert sorted((i, *s) for i, r in got.items() for s in r.spans) == sorted(map(tuple, spans.collect()))
