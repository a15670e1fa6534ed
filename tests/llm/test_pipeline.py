"""The corpus pipeline, stage by stage, against plain versions of what each decides."""

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tessera.llm import mixture, packing, toxicity
from tessera.llm.storage import keep

from .test_decontaminate import brute as contaminated
from .test_near_dedup import brute as near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SF), name)
        out.append((name, docs))
    return dict(out)


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "packing"]
    for name in ("toxicity", "near_dedup", "decontamination", "mixing"):
        assert steps[name].schema == steps["documents"].schema


def test_toxic_documents_go_and_others_stay(spark, steps):
    model = toxicity.fit(steps["documents"], spark.read.parquet(f"{SF}/labels.parquet"))
    rows = steps["documents"].collect()
    score = toxicity.score(pa.array([r.text for r in rows]), model)
    assert ids(steps["toxicity"]) == sorted(r.doc_id for r, s in zip(rows, score) if s < 0.5)


def test_one_document_of_each_group_stays(steps):
    rows = [(r.doc_id, r.text) for r in steps["toxicity"].collect()]
    assert ids(steps["near_dedup"]) == sorted(i for i, _, c in near(rows, 5, 80) if i == c)


def test_contaminated_documents_go(steps):
    rows = [(r.doc_id, r.text) for r in steps["near_dedup"].collect()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    assert ids(steps["decontamination"]) == sorted(i for i, _, _, _, bad in contaminated(rows, items) if not bad)


def test_the_mix_follows_its_targets(steps):
    before, after = steps["decontamination"], steps["mixing"]
    count = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(mixture.word_count(F.col("text"))).alias("n")).collect()}
    had, have = count(before), count(after)
    names = sorted(had)
    for s, t in zip(names, mixture.target_sizes([had[s] for s in names], [i % 3 + 1 for i in range(len(names))]), strict=True):
        assert abs(have.get(s, 0) - t) <= max(100, 0.03 * t)
    texts = {r.doc_id: r.text for r in before.collect()}
    assert all(r.text in texts[r.doc_id] for r in after.collect() if r.text)


def test_every_token_of_the_mix_is_packed_once(steps):
    import base64

    import tiktoken

    with open(packing.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("plain", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = np.zeros(1 << 16, np.int64)
    for r in steps["mixing"].collect():
        np.add.at(want, encoding.encode_ordinary(r.text or ""), 1)
    got = np.zeros(1 << 16, np.int64)
    for r in steps["packing"].collect():
        np.add.at(got, np.frombuffer(r.input_ids, "<u2")[: r.n_tokens], 1)
        assert r.n_tokens <= packing.LENGTH
    assert (got == want).all()


def test_run_is_the_stages_in_a_row(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert got.schema == steps["packing"].schema and corpus_pipeline.ORACLE_SQL is None
    key = lambda df: sorted((r.n_tokens, len(r.doc_ids)) for r in df.collect())
    assert key(got) == key(steps["packing"])


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SF), "empty")
    assert docs.count() == 0


def odd_rows(docs):
    """Rows of every kind, and columns that are named like what the stages make."""
    rows = [tuple(r) for r in docs.limit(60).collect()]
    names = docs.columns
    make = lambda i, text, source="src1", lang="en": tuple({"doc_id": i, "text": text, "lang": lang, "source": source, "n_chars": len(text or "")}[c] for c in names)
    long = " ".join(f"w{i % 5003}" for i in range(120_000))
    rows += [make(90_001, None), make(90_002, ""), make(90_003, " \n\t"), make(None, "a row without an id, said once"), make(None, None), make(90_004, long), make(90_005, long), make(90_006, "no source", None), make(90_007, "no language", "src2", None), make(90_008, "x" * 300_000), rows[0], rows[0], make(rows[1][names.index("doc_id")], "another text of an id that is there")]
    clashes = [c for c in ("score", "predicted", "kept", "component_id", "n_words", "contaminated", "size", "taken", "__size", "__id", "c0", "id", "row", "h") if c not in names]
    spark = docs.sparkSession
    schema = docs.schema
    for c in clashes:
        schema = schema.add(c, IntegerType())
    return spark.createDataFrame([(*r, *range(len(clashes))) for r in rows], schema), make


def test_stages_take_rows_of_every_kind(spark):
    docs, _ = odd_rows(spark.read.parquet(f"{SF}/documents.parquet"))
    sizes, stages = {}, dict(corpus_pipeline.STAGES)
    here = {}
    for name in ("toxicity", "near_dedup", "decontamination", "mixing"):
        before = docs
        docs = keep(stages[name](spark, before, SF), f"odd-{name}")
        assert docs.schema == before.schema
        sizes[name] = docs.count()
        here[name] = {r.doc_id for r in docs.collect()}
    first = here["toxicity"]
    assert {90_001, 90_002, 90_003, 90_004, 90_005, 90_006, 90_007, 90_008, None} <= first
    assert {90_001, 90_002, 90_003, 90_004, 90_006, 90_008, None} <= here["near_dedup"] and 90_005 not in here["near_dedup"]
    assert here["decontamination"] <= here["near_dedup"] and {90_001, 90_002, 90_003, 90_004, None} <= here["decontamination"]
    assert not {90_001, 90_002, 90_003} & here["mixing"]
    packed = stages["packing"](spark, docs, SF).collect()
    assert {i for r in packed for i in r.doc_ids} == here["mixing"]
    again = keep(stages["near_dedup"](spark, keep(stages["toxicity"](spark, odd_rows(spark.read.parquet(f"{SF}/documents.parquet"))[0].repartition(5), SF), "odd"), SF), "odd-again")
    assert again.count() == sizes["near_dedup"]
