import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import kernel, lm_score, storage


def ids_of(text):
    raw, at, _ = kernel.string_buffers(pa.array([text or ""]))
    c, p = lm_score._ids(kernel.Words(raw, at, kernel.alnum_words()))
    return c.tolist(), p.tolist()


def brute(rows, members):
    """(id, words, target loss, background loss), each without the text's own counts."""
    out, size = [], len({c for _, t in rows for c in ids_of(t)[0]})
    for k, (i, text) in enumerate(rows):
        losses = []
        for model in ("target", "ground"):
            words, pairs = {}, {}
            texts = sum(bool(ids_of(t)[0]) for j, (d, t) in enumerate(rows) if j != k and (model == "ground" or d in members))
            for j, (d, t) in enumerate(rows):
                if j != k and (model == "ground" or d in members):
                    for c, p in zip(*ids_of(t)):
                        words[c], pairs[p] = words.get(c, 0) + 1, pairs.get(p, 0) + 1
            total, loss, before = sum(words.values()), [], None
            for c, p in zip(*ids_of(text)):
                single = (words.get(c, 0) + lm_score.BETA) / (total + lm_score.BETA * size)
                context = texts if before is None else words.get(before, 0)
                loss.append(-math.log((pairs.get(p, 0) + lm_score.ALPHA * single) / (context + lm_score.ALPHA)))
                before = c
            losses.append(sum(loss) / len(loss) if loss else 0.0)
        out.append((i, len(ids_of(text)[0]), *losses))
    return out


def made_up(n=40, seed=2):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(["red", "green", "blue"] if i % 2 else ["one", "two", "three", "four"]) for _ in range(rng.randint(1, 30)))) for i in range(n)]


def test_same_as_brute_force(spark):
    rows = made_up() + [(100, ""), (101, None), (102, "red one RED-one")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    members = [1, 3, 5, 7, 9, 100, 100]
    target = spark.createDataFrame([(m,) for m in members], "doc_id long")
    got = {r.doc_id: r for r in lm_score.scores(docs, lm_score.fit(docs, target), target).collect()}
    assert len(got) == len(rows)
    for i, n, t, g in brute(rows, set(members)):
        assert got[i].n_words == n
        assert got[i].target_loss == pytest.approx(t, abs=1e-9) and got[i].background_loss == pytest.approx(g, abs=1e-9)
        assert got[i].score == pytest.approx(t - g, abs=1e-9)


def test_texts_like_the_target_score_lower(spark):
    rows = made_up(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i in range(1, 200, 2)], "doc_id long")
    got = lm_score.scores(docs, lm_score.fit(docs, target), target).where("doc_id >= 200").collect()
    like, other = [r.score for r in got if r.doc_id % 2], [r.score for r in got if not r.doc_id % 2]
    assert np.mean(like) < np.mean(other) and max(like) < min(other)


def test_no_target_and_empty_tables(spark):
    docs = spark.createDataFrame(made_up(3), "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert lm_score.scores(docs, lm_score.fit(docs, none), none).count() == 3
    assert lm_score.scores(docs.limit(0), lm_score.fit(docs.limit(0), none), none).count() == 0


@pytest.mark.parametrize("chunk", [1 << 19, 700])
def test_every_word_and_pair_has_counts_of_its_own(spark, monkeypatch, chunk):
    """By n-grams of strings, over more pairs than fixed tables could tell apart."""
    monkeypatch.setattr(lm_score, "CHUNK_WORDS", chunk)
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.3)) % 60_000}" for _ in range(300))) for i in range(400)]
    members = set(range(0, 400, 5))
    grams = lambda text: [*((w,) for w in text.split()), *zip([None, *text.split()], text.split())]
    models = []
    for chosen in (members, range(400)):
        counts = {}
        for i, text in rows:
            for g in grams(text) if i in chosen else ():
                counts[g] = counts.get(g, 0) + 1
        models.append((counts, sum(v for g, v in counts.items() if len(g) == 1), chosen))
    size = len({w for _, t in rows for w in t.split()})
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    target = spark.createDataFrame([(m,) for m in members], "doc_id long")
    again = docs.select("doc_id", "text")  # scored by models of another frame
    assert lm_score.fit(docs, target).vocabulary == size
    for scored in (docs, again):
        got = {r.doc_id: r for r in lm_score.scores(scored, lm_score.fit(docs, target), target).collect()}
        assert len(got) == len(rows)
        for i, text in rows[::7]:
            want = []
            for counts, total, chosen in models:
                own = {}
                for g in grams(text) if i in chosen else ():
                    own[g] = own.get(g, 0) + 1
                left = lambda g, counts=counts, own=own: counts.get(g, 0) - own.get(g, 0)
                words = total - (300 if i in chosen else 0)
                loss = 0.0
                for a, b in zip([None, *text.split()], text.split()):
                    context = len(chosen) - (i in chosen) if a is None else left((a,))
                    single = (left((b,)) + lm_score.BETA) / (words + lm_score.BETA * size)
                    loss -= math.log((left((a, b)) + lm_score.ALPHA * single) / (context + lm_score.ALPHA))
                want.append(loss / 300)
            assert got[i].target_loss == pytest.approx(want[0], abs=1e-9) and got[i].background_loss == pytest.approx(want[1], abs=1e-9)


def test_probabilities_of_all_words_sum_to_one(spark):
    """After each context: over the vocabulary, and the end of a text."""
    rows = [(1, "a b a c"), (2, "a b"), (3, "c c b"), (4, ""), (5, "d a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    models = lm_score.fit(docs, none)
    assert models.vocabulary == 4 and models.texts == (0, 4) and models.totals == (0, 12)
    counts = lambda *w: np.array([sum(t.split().count(x) for _, t in rows) for x in w])
    words = "a b c d".split()
    for before, context, ends in (("a", 4, 0), ("b", 4, 3), (None, 4, 0)):
        pair = np.array([sum(list(zip([None, *t.split()], t.split())).count((before, w)) for _, t in rows) for w in words])
        p = np.exp(-lm_score._loss(counts(*words), pair, np.full(4, context), np.full(4, 12), models.vocabulary))
        assert p.sum() + ends / (context + lm_score.ALPHA) == pytest.approx(1)


@pytest.mark.parametrize("held", [1 << 20, 1000])
def test_vocabulary_is_counted_exactly(spark, monkeypatch, held):
    monkeypatch.setattr(lm_score, "HELD_WORDS", held)
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i * 50, i * 50 + 100))) for i in range(400)], "doc_id long, text string").repartition(5)
    assert lm_score.fit(docs, docs.select("doc_id")).vocabulary == 20_050


def test_many_target_ids_meet_texts_in_a_shuffle_that_is_stored(spark, monkeypatch):
    docs = spark.createDataFrame([*made_up(60), (None, "red one"), (None, "red one"), (7, "red blue")], "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(i,) for i in range(0, 60, 4)], "doc_id long")
    rows = lambda: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in lm_score.scores(docs.fillna({"doc_id": -1}), lm_score.fit(docs.fillna({"doc_id": -1}), target), target).collect())
    want = rows()
    monkeypatch.setattr(storage, "FEW_BYTES", 0)
    models = lm_score.fit(docs, target)
    assert "parquet" in models.marked._jdf.queryExecution().toString().lower()
    assert rows() == want


def test_long_texts_repeated_rows_and_rows_without_id(spark):
    long = " ".join(f"w{i % 700}" for i in range(120_000))
    rows = [(1, long), (1, long), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (2, "w5 w6")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, bucket string")
    target = spark.createDataFrame([(2,), (None,)], "doc_id long")
    got = sorted(((r.doc_id, r.n_words, round(r.score, 9)) for r in lm_score.scores(docs, lm_score.fit(docs, target), target).collect()), key=str)
    assert [g[:2] for g in got] == [(1, 120_000), (1, 120_000), (2, 2), (None, 3), (None, 3)]
    assert got[0] == got[1] and got[3] == got[4]
    assert [(i, n) for i, n, *_ in brute(rows[2:], {2})] == [(None, 3), (None, 3), (2, 2)]
