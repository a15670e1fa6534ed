"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

A query's time is that of a full run to a no-op sink; each runs once before, on the
smallest tables, so that the session is warm as a resident service would be.  hybrid_search
builds its keyword index anew; search_stored_index is the same search by an index that was
stored before, as a service has it, and keyword_index the time to build and store that; topk_stored_lists is the
ten best by inverted lists that were stored before, and inverted_lists the time to make these.
"queries" and "value" are of HEADLINE; the rest is told apart."""

import importlib.util
import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ["bm25_topk", "cosine_topk", "hybrid_search", "hybrid_filtered", "hit_rate_at_5", "document_frequencies", "chunk_regulations", "paragraph_pack", "html_to_text", "popular_queries", "log_summary", "contact_groups"]


def timed(make, warm: str, sf: str) -> float:
    """Seconds of a full run over ``sf``, after one over ``warm``."""
    make(warm).write.format("noop").mode("overwrite").save()
    began = time.time()
    make(sf).write.format("noop").mode("overwrite").save()
    return round(time.time() - began, 3)


def stored_index(spark, warm: str, sf: str) -> dict[str, float]:
    """Seconds to build and store the keyword index, and of the hybrid search by it."""
    from tessera import queries as q
    from tessera.operators import keyword, postings
    from tessera.plans import search
    from tessera.storage import shared_folder

    path, seconds = f"{shared_folder(spark)}/bench-index", {}
    for at in (warm, sf):
        began = time.time()
        keyword.write_index(keyword.build(q._chunks(spark, at).select("chunk_id", search.searched_text().alias("text")), "chunk_id"), f"{path}/{Path(at).name}")
        seconds["keyword_index"] = round(time.time() - began, 3)

    def make(at):
        asked = q._questions(spark, at).join(q._question_vectors(spark, at), "qid", "left")
        index = keyword.read_index(spark, f"{path}/{Path(at).name}")
        return search.search(asked, q._chunks(spark, at), q._vectors(spark, at), q._regulations(spark, at), vector_floor=0.2, index=index)

    seconds["search_stored_index"] = timed(make, warm, sf)
    for at in (warm, sf):
        began = time.time()
        postings.build(keyword.read_index(spark, f"{path}/{Path(at).name}"), f"{path}/{Path(at).name}-lists")
        seconds["inverted_lists"] = round(time.time() - began, 3)
    seconds["topk_stored_lists"] = timed(lambda at: postings.topk(postings.read(spark, f"{path}/{Path(at).name}-lists"), q._questions(spark, at), 10), warm, sf)
    return seconds


def main() -> None:
    from pyspark.sql import SparkSession

    from tessera.queries import QUERIES

    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm = str(Path(sf).parent / "sf0.001")
    warm = warm if os.path.isdir(warm) else sf
    seconds = {}
    for name in HEADLINE:
        seconds[name] = timed(lambda sf, name=name: QUERIES[name](spark, sf), warm, sf)
    apart = stored_index(spark, warm, sf)
    if importlib.util.find_spec("tessera.llm") and importlib.util.find_spec("tessera.llm.queries"):
        from tessera.llm.queries import QUERIES as more

        apart |= {name: timed(lambda sf, q=q: q(spark, sf), warm, sf) for name, q in more.items()}
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    line = {"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf, "apart": apart}
    line["per_question_ms"] = {q: round(1000 * (seconds | apart)[q] / max(asked, 1), 2) for q in ("bm25_topk", "cosine_topk", "hybrid_search", "search_stored_index", "topk_stored_lists")}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
