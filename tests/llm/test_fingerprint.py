import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from tessera.llm import fingerprint as fp

A, B, C = "Alpha beta gamma delta epsilon.", "zeta eta theta", "iota"


def test_order_of_paragraphs_does_not_matter():
    assert fp.fingerprint(f"{A}\n{B}\n\n{C}") == fp.fingerprint(f"{C}\n{A}\n{B}")
    assert fp.fingerprint(f"{A}\n{B}") != fp.fingerprint(f"{A} {B}")
    assert fp.fingerprint(f"{A}\n{A}") != fp.fingerprint(A)


def test_paragraphs_are_put_in_and_taken_out():
    both = fp.insert(fp.fingerprint(A), fp.fingerprint(B))
    assert both == fp.fingerprint(f"{B}\n{A}")
    assert fp.insert(both, fp.fingerprint(B), -1) == fp.fingerprint(A)
    assert fp.insert(fp.fingerprint(None), fp.fingerprint(C), 3) == fp.fingerprint("\n".join([C] * 3))


def test_likeness_follows_shared_text():
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    text = lambda a, b: "\n".join(" ".join(words[i : i + 20]) for i in range(a, b, 20))
    exact, like = fp.vectors(pa.array([text(0, 2000), text(0, 2000), text(1000, 3000), text(2000, 4000), "", None]))
    near = lambda i, j: fp.likeness(exact[i : i + 1], like[i : i + 1], exact[j : j + 1], like[j : j + 1])[0]
    assert near(0, 1) == 1 and near(4, 5) == 1 and near(0, 4) < 0.3
    assert near(0, 2) == pytest.approx(0.5, abs=0.2) and near(0, 3) < 0.3


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.fingerprint(t), fp.fingerprint(edited)))
    return out


def report(df):
    return [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in fp.fingerprints(df).collect()]


def test_same_as_brute_force(spark):
    rng = random.Random(5)
    rows = [(i * 2, "\n".join(" ".join(rng.choice(["é", "ab", "😀", "Wort"]) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(6)))) for i in range(60)]
    rows += [(None, "first of all"), (1, None), (3, ""), (119, "x" * 300_000 + "\ny")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n_chars int, fingerprint string").repartition(5)
    got = report(df)
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in fp.fingerprints(df).collect())


def test_one_row_repeated_rows_and_none(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert report(make([(4, "abcd")])) == brute([(4, "abcd")])
    assert report(make([(4, "abcd")] * 3)) == brute([(4, "abcd")] * 3)
    assert report(make([])) == []


@pytest.mark.parametrize("runs", [33_000, 65_536])
def test_one_run_repeated_many_times(runs):
    long, longer, other = "a " * (runs + 2), "a " * (runs + 1002), "b " * (runs + 2)
    exact, like = fp.vectors(pa.array([long, longer, other]))
    near = lambda i, j: fp.likeness(exact[i : i + 1], like[i : i + 1], exact[j : j + 1], like[j : j + 1])[0]
    assert (abs(like[0].astype("int32")) == runs).all()
    assert near(0, 1) > 0.99 and near(0, 2) < 0.3
    assert all((a == b).all() for a, b in zip(fp.decode(fp.encode(exact, like)[1]), (exact[1], like[1])))


def shared_share(a, b):
    """The share of three-word runs, counted with repeats, that two texts of long lines have in common."""
    runs = [Counter(tuple(w[i : i + 3]) for line in t.split("\n") for w in [line.split()] for i in range(len(w) - 2)) for t in (a, b)]
    return 2 * sum((runs[0] & runs[1]).values()) / max(1, sum(runs[0].values()) + sum(runs[1].values()))


def test_likeness_against_counted_runs(spark):
    rng = random.Random(4)
    lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(400)]
    rows = [(i, "\n".join(lines[i * 5 + j] for j in range(rng.randint(5, 40)))) for i in range(60)]
    texts = dict(rows)
    got = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    wrong = []
    for r in got:
        text, following = texts[r.doc_id], texts[(r.doc_id + 1) % 60]
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        wrong += [r.near_next - shared_share(text, following), r.near_edited - shared_share(text, edited)]
    assert len(wrong) == 120 and max(map(abs, wrong)) < 0.35 and sum(map(abs, wrong)) / 120 < 0.09


def test_ranges_meet_in_order(spark):
    rows = [(i, f"text {i}") for i in range(0, 300, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(report(df)) == sorted(brute(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
