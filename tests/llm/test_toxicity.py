import random
import re
import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm.boosting import Boosted, isotonic


def made_up(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    rows = []
    for i in range(n):
        text, toxic = [word() for _ in range(rng.randint(5, 80))], int(rng.random() < 0.15)
        for _ in range(1 + len(text) // 20 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["qroz", "you qroz", "Vlimt!", "zorkan"]))
        rows.append((i, " ".join(text), toxic))
    return rows


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_held_out_documents_are_told_apart(spark):
    rows = made_up(1500)
    docs = spark.createDataFrame([(i, t, "en", 0.5) for i, t, _ in rows] + [(9001, "", "en", 0.5), (9002, None, "en", 0.5), (None, "qroz", "en", 0.5)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (77, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    y, s = np.array([truth[r.doc_id] for r in held]), np.array([r.score for r in held])
    assert auc(s, y) > 0.97 and ((s >= 0.5) == (y == 1)).mean() > 0.95


def test_held_out_labels_are_not_learned_from(spark):
    rows = made_up(300)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda lab: sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, toxicity.fit(docs, lab)).collect())
    assert key(labels) == key(turned)


def test_no_labels_or_one_kind(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxicity(docs, toxicity.fit(docs, none)).collect()] == [0.0, 0.0]
    assert toxicity.train(["a", "b"], [1, 1], [0, 1]) == {"constant": 1.0}
    assert toxicity.toxicity(docs.limit(0), {"constant": 0.2}).count() == 0


def test_clean_documents_stay_whole(spark):
    model = toxicity.train([t for _, t, _ in made_up(900)], [y for *_, y in made_up(900)], [i % 4 for i in range(900)])
    docs = spark.createDataFrame([(1, "abc def you qroz qroz", 3), (2, "abc def gh", 4), (3, None, 5)], "doc_id long, text string, predicted int")
    got = toxicity.without_toxic(docs, model)
    assert got.schema == docs.schema and sorted(r.doc_id for r in got.collect()) == [2, 3]


def test_calibration_is_monotone():
    rng = np.random.default_rng(3)
    s = rng.random(500)
    x, y = isotonic(s, (rng.random(500) < s**2).astype(float))
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= -1e-12).all()


def test_boosting_learns_an_interaction():
    x = np.random.default_rng(1).random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((Boosted(rounds=40).fit(x, y).predict(x) > 0.5) == y).mean() > 0.95


def test_symbols_for_letters_count_as_hidden():
    words = toxicity.kernel.Words(*toxicity.kernel.string_buffers(pa.array(["idiot"]))[:2], toxicity.kernel.alnum_words())
    none = np.zeros(0, np.uint64)
    x = toxicity.features(pa.array(["an 1d10t here", "an idiot here"]), {"strong": np.sort(words.hash), "mild": none, "begins": none})
    assert x[0, 5] > 0 and x[0, 0] == 0 and x[1, 0] > 0 and x[1, 5] == 0


def test_the_sample_is_bounded_and_the_same_in_any_layout(spark):
    rows = [r for r in made_up(400) if zlib.crc32(str(r[0]).encode()) % 5]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] * 2, "doc_id long, toxic int")
    texts = [(i, t) for i, t, _ in rows] * 3 + [(rows[0][0], "another text of an id that repeats"), (rows[1][0], None)]
    random.Random(4).shuffle(texts)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    take = lambda df, most, size: toxicity._sample(df, labels, "doc_id", "text", "toxic", most, size).to_pylist()
    all_rows = take(docs, 1000, 1 << 20)
    assert len(all_rows) == len(rows) + 2 and {(r["__id"], r["__text"]) for r in all_rows} == set(texts)
    few = take(docs, 50, 1 << 20)
    assert len(few) <= 52 and take(docs.repartition(7), 50, 1 << 20) == few
    small = take(docs, 1000, 2000)
    assert 0 < sum(len(r["__text"] or "") for r in small) <= 2000 and take(docs.coalesce(1), 1000, 2000) == small
    assert toxicity.fit(docs, labels)["knots"][1].tolist() == toxicity.fit(docs.repartition(5), labels)["knots"][1].tolist()


def test_long_repeated_and_clashing(spark):
    rows = made_up(900)
    model = toxicity.train([t for _, t, _ in rows], [y for *_, y in rows], [i % 4 for i in range(900)])
    clean = " ".join("abc de fgh"[: 3 + i % 7] for i in range(200_000))
    toxic = " ".join("you qroz vlimt zorkan" if i % 9 == 0 else "abc" for i in range(100_000))
    docs = spark.createDataFrame([(1, clean, 1, 2), (1, clean, 1, 2), (None, toxic, 3, 4), (2, toxic, 5, 6)], "doc_id long, text string, held_out int, id int")
    got = sorted(((r.doc_id, r.predicted) for r in toxicity.toxicity(docs, model).collect()), key=str)
    assert got == [(1, 0), (1, 0), (2, 1), (None, 1)]
    left = toxicity.without_toxic(docs, model)
    assert left.schema == docs.schema and [r.doc_id for r in left.collect()] == [1, 1]


def brute_features(text, lexicon):
    """Lexicon counts and rates of one text, word by word."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    strong, person = [w in lexicon for w in words], [w in toxicity.SECOND_PERSON for w in words]
    close = [s and any(person[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]) for i, s in enumerate(strong)]
    data = text.encode()
    letters = [chr(b).isascii() and chr(b).isalpha() or b >= 0x80 for b in data]
    n = max(len(words), 1)
    return [sum(strong) / n, sum(person) / n, sum(close) / n, sum(65 <= b <= 90 for b in data) / max(sum(letters), 1), data.count(b"!") / max(len(data), 1), np.log1p(len(words))]


def test_features_as_counted_word_by_word():
    rng = random.Random(8)
    lexicon = ["qroz", "vlimt", "zörk"]
    texts = [" ".join(rng.choice(["You", "qroz", "VLIMT!", "zörk,", "abc", "you", "dich", "é!", "12", "--"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    raw, at, _ = toxicity.kernel.string_buffers(pa.array(lexicon))
    none = np.zeros(0, np.uint64)
    x = toxicity.features(pa.array(texts), {"strong": np.sort(toxicity.kernel.Words(raw, at, toxicity.kernel.alnum_words()).hash), "mild": none, "begins": none})
    assert np.allclose(x[:, [0, 6, 7, 9, 11, 14]], [brute_features(t, lexicon) for t in texts])


def test_long_texts_and_labels_of_other_documents_leave_a_sample(spark):
    rows = [r for r in made_up(400) if zlib.crc32(str(r[0]).encode()) % 5]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    take = lambda d, l, most, size: toxicity._sample(d, l, "doc_id", "text", "toxic", most, size).to_pylist()
    size = sum(len(t) for _, t, _ in rows)
    long = docs.select("doc_id", F.when(F.xxhash64(F.lit(7), "doc_id") == docs.select(F.min(F.xxhash64(F.lit(7), "doc_id"))).first()[0], F.repeat(F.lit("qroz "), 100_000)).otherwise(F.col("text")).alias("text"))
    assert len(take(long, labels, 1000, size)) == len(rows) - 1  # the first one does not fit, all others do
    others = labels.union(spark.range(10_000, 18_000).select("id", F.lit(1)))
    assert len(take(docs, others, 200, 1 << 20)) == 200
    model = toxicity.fit(long, labels, most_bytes=size)
    assert "trees" in model
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert toxicity.fit(docs, labels, most_bytes=1) == {"constant": 0.0}
    assert any("nothing is learned" in str(w.message) for w in said)


def test_scores_are_sums_over_trees_and_steps_of_the_calibration():
    rows = made_up(600)
    model = toxicity.train([t for _, t, _ in rows], [y for *_, y in rows], [i % 4 for i in range(600)])
    texts = [t for _, t, _ in rows[:80]] + ["", None]
    x = toxicity.features(pa.array(texts), model["lexicon"])
    plain = Boosted.__new__(Boosted)
    vars(plain).update(model["trees"])
    low, high = model["knots"]
    for i, got in enumerate(toxicity.score(pa.array(texts), model)):
        raw = float(plain.predict(x[i : i + 1])[0])
        k = int(np.searchsorted(low, raw))
        if 0 < k < len(low):
            step = high[k - 1] + (high[k] - high[k - 1]) * (raw - low[k - 1]) / (low[k] - low[k - 1]) if low[k] > low[k - 1] else high[k]
        else:
            step = high[0] if k == 0 else high[-1]
        assert abs(got - min(max(0.999 * step + 0.001 * raw, 0), 1)) < 1e-9
    assert all(a <= b for a, b in zip(high, high[1:]))
