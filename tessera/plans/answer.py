"""Answers to questions: search, gate, context, generation behind an interface, guardrails."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import answers

UNAVAILABLE = "사용 가능한 LLM이 없어 검색 결과만 반환합니다"
SYSTEM = "Answer from the given reference only; say that the rules do not cover it otherwise; name the rules used."


def prompts(queries: DataFrame, results: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, text, found, context, sources, related_regulations, prompt): what a model needs.

    ``queries`` may have ``history``, an array of (question, answer)."""
    from ..operators.ranking import related

    rows = queries.join(answers.gated(queries, results), "qid").join(answers.context(results, chunks), "qid", "left").join(answers.sources_block(results), "qid", "left").join(related(results), "qid", "left")
    block = F.lit("")
    if "history" in queries.columns:
        turns = F.transform(answers.recent_history(F.col("history"), 2), lambda t: F.concat(F.lit("Q: "), t["question"], F.when(t["answer"] != "", F.concat(F.lit("\nA: "), t["answer"])).otherwise("")))
        block = F.when(F.size(turns) > 0, F.concat(F.lit("[이전 대화]\n"), F.array_join(turns, "\n"), F.lit("\n\n"))).otherwise("")
    prompt = F.concat(block, F.lit("[참고자료]\n"), F.coalesce("context", F.lit("")), F.lit("\n\n[질문]\n"), F.col("text"))
    return rows.select("qid", "text", "found", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce("related_regulations", F.array().cast("array<string>")).alias("related_regulations"), prompt.alias("prompt"))


def answer(prompted: DataFrame, backend: answers.Backend | Callable, names: list[str]) -> DataFrame:
    """(qid, answer, found, used_llm, status, reason, error, ...): refusals where the gate is shut, else guarded
    answers.  Where the backend is unavailable, or fails at a prompt, the sources alone are given:
    both have the status fallback_no_llm, and ``reason`` tells them apart.  A plain function takes and returns a Series of texts, batch by
    batch; a null answer is a failure."""
    model = _generated(backend)
    none = F.array().cast("array<string>")
    given = lambda rows, text, used, status, reason="", error=F.lit(""), uncited=none, foreign=none: rows.select("qid", text.alias("answer"), "found", F.lit(used).alias("used_llm"), F.lit(status).alias("status"), F.lit(reason).alias("reason"), error.alias("error"), uncited.alias("uncited"), foreign.alias("foreign_numbers"))
    alone = lambda why: F.concat(F.lit("[생성 불가: "), why, F.lit("]\n\n"), F.col("sources"))
    shut = given(prompted.where(~F.col("found")), F.lit(C.NOT_FOUND), False, "refused")
    open_ = prompted.where("found")
    if not getattr(backend, "is_available", lambda: True)():
        return shut.union(given(open_, alone(F.lit(UNAVAILABLE)), False, "fallback_no_llm", "unavailable"))
    made = open_.withColumn("__made", model("prompt")).withColumns({"generated": F.col("__made.text"), "error": F.col("__made.error")})
    failed = given(made.where("generated is null"), alone(F.col("error")), False, "fallback_no_llm", "failed", F.col("error"))
    done = answers.finalised(made.where("generated is not null"), names)
    return shut.union(failed).union(given(done, F.col("answer"), True, "answered", "", F.lit(""), F.col("uncited"), F.col("foreign_numbers")))


def _generated(backend):
    """struct(text, error) for each prompt; one prompt's failure is no other's."""

    @F.pandas_udf("text string, error string")
    def model(p: pd.Series) -> pd.DataFrame:
        out = []
        if hasattr(backend, "generate"):
            for prompt in p:
                try:
                    out.append((backend.generate(SYSTEM, prompt), None))
                except Exception as e:
                    out.append((None, str(e)))
        else:
            try:
                out = [(t, None) for t in backend(p)]
            except Exception as e:
                out = [(None, str(e))] * len(p)
        return pd.DataFrame([(t, None if t is not None else e or "no answer") for t, e in out], columns=["text", "error"])

    return model


def answer_stream(prompt: dict, backend: answers.Backend):
    """Pieces of one answer as the backend makes them; a refusal or the sources where it makes none.
    ``prompt`` is a row of prompts() as a dict.  For one interactive question: no Spark job."""
    if not prompt["found"]:
        yield C.NOT_FOUND
    elif not backend.is_available():
        yield f"[생성 불가: {UNAVAILABLE}]\n\n{prompt['sources']}"
    else:
        try:
            yield from backend.generate_stream(SYSTEM, prompt["prompt"])
        except Exception as e:
            yield f"[생성 불가: {e}]\n\n{prompt['sources']}"
