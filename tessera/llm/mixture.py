"""Mixing sources to target weights by Sainte-Laguë apportionment.

A source's documents are dealt to shards, each shard's words are cut to blocks of equal
size, and blocks are seats: sources get theirs by highest quotients of their targets,
shards of a source theirs by highest quotients of their sizes.  A shard takes all of
its blocks as often as its quota covers them, and the rest of the quota as a seeded
choice: a run of blocks from a seeded place on, in a seeded order of documents.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import attach
from . import kernel
from .storage import keep, local

#: Words in a block, as nearly as a shard's size allows.
BLOCK = 64
#: Documents in a shard, until there are MOST_SHARDS.
SHARD_DOCS = 2000
#: Shards at most, but for one of each source, and sources whose numbers are on the driver.
MOST_SHARDS, MOST_SOURCES = 1 << 16, 1 << 16
#: Bytes of text whose rows of the mix are made at a time.
OUTPUT_BYTES = 2 << 20
#: Most times that a word is taken.
REPEATS = 3


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint"), F.lit(0).cast("bigint"))


def target_sizes(sizes: list[int], weights: list[int], repeats: int = REPEATS) -> list[float]:
    """Shares of all words by weight; a source's stops at ``repeats`` times its size, and
    the others share the excess by weight until none is above."""
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > repeats * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def sainte_lague(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by highest quotients votes / (2 n + 1), none above its cap; earlier wins a tie.

    Equal to dealing seats one by one, but by bisection for the common divisor, so that
    billions of seats are no work; only the last few are dealt singly."""
    votes, caps = np.asarray(votes, float), np.asarray(caps, np.int64)
    seats = int(min(seats, caps[votes > 0].sum()))
    if seats <= 0 or not len(votes):
        return np.zeros(len(votes), np.int64)
    given = lambda d: np.minimum(np.floor(votes / d + 0.5), caps).astype(np.int64)
    lo, hi = 0.0, 2.0 * votes.max() + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        if not lo < mid < hi:
            break
        lo, hi = (lo, mid) if given(mid).sum() <= seats else (mid, hi)
    out = given(hi)
    heap = [(-v / (2 * n + 1), i) for i, (v, n, c) in enumerate(zip(votes, out, caps, strict=True)) if n < c and v > 0]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def _placed(sized: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Rows (__id, __source, __size, ...) with their source's plan and shard."""
    met = sized.join(plan, sized["__source"].eqNullSafe(plan["__name"]))
    return met.withColumn("__shard", F.pmod(F.xxhash64(F.lit(seed), "__id", "__size"), F.col("__shards")))


def _shard_row(shards: DataFrame, seed: int) -> DataFrame:
    """What a shard (__index, __shard, size, blocks, quota) takes: all of it __times, and the word ranges from
    __f to __l and from __f2 to __l2, those of the rest's blocks, from a seeded block on, once more."""
    n, q = F.col("blocks"), F.col("quota")
    first = F.crc32(F.concat_ws("/", F.lit(str(seed)), "__index", "__shard").cast("binary")) % F.greatest(n, F.lit(1))
    rest = F.when(n > 0, q % n).otherwise(0)
    at = lambda b: F.when(n > 0, F.floor(F.expr(f"({b}) * size div blocks"))).otherwise(0).cast("bigint")
    rows = shards.withColumns({"__first": first, "__rest": rest}).withColumns({"__end": F.least(F.col("__first") + F.col("__rest"), n), "__over": F.greatest(F.col("__first") + F.col("__rest") - n, F.lit(0))})
    return rows.select("__index", "__shard", F.when(n > 0, F.floor(F.expr("quota div blocks"))).otherwise(0).cast("bigint").alias("__times"), at("__first").alias("__f"), at("__end").alias("__l"), F.lit(0).cast("bigint").alias("__f2"), at("__over").alias("__l2"))


def _few_sources(sources: DataFrame, narrow: DataFrame, per_shard: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(plan of sources, what each shard takes), with the numbers of both on the driver."""
    spark = sources.sparkSession
    rows = sorted(sources.collect(), key=lambda r: (r["__source"] is None, r["__source"] or ""))
    sizes = [r["size"] for r in rows]
    targets = target_sizes(sizes, [i % 3 + 1 for i in range(len(rows))])
    plan_rows = [(r["__source"], i, r["size"], targets[i], max(1, -(-r["n"] // per_shard))) for i, r in enumerate(rows)]
    plan = F.broadcast(local(spark, plan_rows, f"__name {sources.schema['__source'].dataType.simpleString()}, __index bigint, __source_size bigint, __target double, __shards bigint"))
    shards = _placed(narrow, plan, seed).groupBy("__index", "__shard").agg(F.sum("__size").alias("size")).orderBy("__index", "__shard").collect()
    index, size = np.array([r["__index"] for r in shards], np.int64), np.array([r["size"] for r in shards], np.int64)
    blocks = np.where(size > 0, np.maximum(1, np.rint(size / BLOCK)), 0).astype(np.int64)
    of_source = np.bincount(index, blocks, len(rows)).astype(np.int64)
    votes = np.array([t * n / s if s else 0.0 for t, n, s in zip(targets, of_source.tolist(), sizes, strict=True)])
    seats = sainte_lague(votes, round(float(votes.sum())), REPEATS * of_source)
    quota, edge = np.zeros(len(shards), np.int64), np.searchsorted(index, np.arange(len(rows) + 1))
    for i, n in enumerate(seats.tolist()):
        own = slice(edge[i], edge[i + 1])
        quota[own] = sainte_lague(size[own], n, REPEATS * blocks[own])
    told = [(int(i), r["__shard"], int(v), int(n), int(q)) for i, r, v, n, q in zip(index, shards, size, blocks, quota, strict=True)]
    return plan, F.broadcast(_shard_row(local(spark, told, "__index bigint, __shard bigint, size bigint, blocks bigint, quota bigint"), seed))


def _numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df``, stored, with each row's place in ``order``, from 0 on; counts of partitions are on the driver."""
    rows = df.orderBy(*order).withColumns({"__part": F.spark_partition_id(), "__in": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    rows = keep(rows, "numbered")
    counts = sorted((r["__part"], r["count"]) for r in rows.groupBy("__part").count().collect())
    starts = np.append(0, np.cumsum([n for _, n in counts]))
    before = local(df.sparkSession, [(p, int(b)) for (p, _), b in zip(counts, starts, strict=False)], "__part int, __before bigint")
    return rows.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__in")).drop("__part", "__in", "__before")


def _least(df: DataFrame, amount, enough, lo: float, hi: float) -> float:
    """The least x from ``lo`` to ``hi``, but for rounding, whose sum of ``amount(x)`` over the rows is
    ``enough``; it must be for ``hi``.  Each pass over the rows tries some values."""
    for _ in range(24):
        tried = [x for x in np.linspace(lo, hi, 34)[1:-1].tolist() if lo < x < hi]
        if not tried:
            return hi
        sums = df.agg(*(F.sum(amount(x)).alias(f"x{i}") for i, x in enumerate(tried))).first()
        good = [x for i, x in enumerate(tried) if enough(sums[i])]
        bad = [x for i, x in enumerate(tried) if not enough(sums[i])]
        lo, hi = max([lo, *bad]), min([hi, *good])
    return hi


def _many_sources(sources: DataFrame, narrow: DataFrame, per_shard: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """As _few_sources(), where sources are too many for the driver: levels and divisors are searched for by
    sums over the table of sources."""
    rows = _numbered(sources, [F.col("__source").isNull(), F.col("__source")], "__index").withColumn("w", F.col("__index") % 3 + 1)
    rows = keep(rows, "sources")
    total, most = rows.agg(F.sum("size"), F.max(F.col("size") * REPEATS / F.col("w"))).first()
    full = lambda x: F.col("size") * REPEATS <= F.lit(x) * F.col("w")
    level = _least(rows, lambda x: F.least(F.col("size") * float(REPEATS), F.lit(x) * F.col("w")), lambda s: s >= total, 0.0, float(most)) if total else 0.0
    # The last step in one: what full sources leave, by weight.
    held, weight = rows.agg(F.sum(F.when(full(level * (1 - 1e-12)), F.col("size") * REPEATS).otherwise(0)), F.sum(F.when(full(level * (1 - 1e-12)), 0).otherwise(F.col("w")))).first()
    level = (total - held) / weight if weight else level
    target = F.least(F.col("size") * float(REPEATS), F.lit(level) * F.col("w"))
    plan = keep(rows.select(F.col("__source").alias("__name"), "__index", F.col("size").alias("__source_size"), target.alias("__target"), F.greatest(F.lit(1), F.ceil(F.col("n") / per_shard)).alias("__shards")), "plan")

    shards = _placed(narrow, plan, seed).groupBy("__index", "__shard", "__target", "__source_size").agg(F.sum("__size").alias("size"))
    shards = keep(shards.withColumn("blocks", F.when(F.col("size") > 0, F.greatest(F.lit(1), F.rint(F.col("size") / BLOCK))).otherwise(0).cast("bigint")), "shards")
    voters = shards.groupBy("__index", "__target", "__source_size").agg(F.sum("blocks").alias("n"), F.count("*").alias("shards"))
    voters = keep(voters.select("__index", "shards", F.col("n"), (F.col("n") * REPEATS).alias("cap"), F.when(F.col("__source_size") > 0, F.col("__target") * F.col("n") / F.col("__source_size")).otherwise(0.0).alias("v")), "voters")
    votes, top, caps = voters.agg(F.sum("v"), F.max("v"), F.sum(F.when(F.col("v") > 0, F.col("cap")).otherwise(0))).first()
    seats = min(round(votes or 0), caps or 0)
    given = lambda d: F.least(F.floor(F.col("v") / F.lit(d) + 0.5), F.col("cap"))
    divisor = _least(voters, given, lambda s: s <= seats, 0.0, 2.0 * top + 1) if seats else 1.0
    voters = voters.withColumn("seats", given(divisor) if seats else F.lit(0).cast("bigint"))
    left = seats - (voters.agg(F.sum("seats")).first()[0] or 0)
    if left > 0:  # equal quotients: the first sources
        next_ = voters.where("seats < cap and v > 0").withColumn("q", F.col("v") / (2 * F.col("seats") + 1))
        lucky = _numbered(next_.select("__index", "q"), [F.round("q", 9).desc(), F.col("__index")], "at").where(F.col("at") < left).select("__index", F.lit(1).alias("more"))
        voters = voters.join(lucky, "__index", "left").withColumn("seats", F.col("seats") + F.coalesce("more", F.lit(0)))
    told = keep(shards.join(voters.select("__index", "seats", "shards"), "__index").select("__index", "__shard", "size", "blocks", "seats", "shards"), "seats")

    def shared(key, table):
        table = table.sort_by("__shard")
        size, blocks = table["size"].to_numpy(), table["blocks"].to_numpy()
        quota = sainte_lague(size, table["seats"][0].as_py(), REPEATS * blocks)
        return pa.table([table["__index"], table["__shard"], table["size"], table["blocks"], pa.array(quota)], names=["__index", "__shard", "size", "blocks", "quota"])

    columns = ["__index", "__shard", "size", "blocks"]
    alone = told.where("shards = 1").select(*columns, F.least("seats", F.col("blocks") * REPEATS).cast("bigint").alias("quota"))
    # Sources of several shards are few, and so are a source's shards: MOST_SHARDS bounds both.
    several = told.where("shards > 1").groupBy("__index").applyInArrow(lambda key, table: shared(key, table), "__index bigint, __shard bigint, size bigint, blocks bigint, quota bigint")
    return plan, _shard_row(alone.union(several), seed)


def _mixed(docs: DataFrame, id_col: str, source_col: str, text_col: str, carry: list[str], seed: int) -> DataFrame:
    """``carry``, whose names must not begin with two underscores, and __id, __size, __source_size, __target,
    __times (of the whole text) and the word ranges [__a, __b) and [__c, __d) that are taken once more."""
    narrow = keep(docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("__size")), "sizes")
    sources = keep(narrow.groupBy("__source").agg(F.sum("__size").alias("size"), F.count("*").alias("n")), "sources")
    many, rows = sources.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    per_shard = max(SHARD_DOCS, -(-rows // MOST_SHARDS))
    plan, table = (_few_sources if many <= MOST_SOURCES else _many_sources)(sources, narrow, per_shard, seed)

    whole = docs.select(*carry, F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("__size")) if carry else narrow
    placed = _placed(whole, plan, seed)
    tie = [F.xxhash64(text_col)] if text_col in carry else []
    order = Window.partitionBy("__index", "__shard").orderBy(F.xxhash64(F.lit(seed + 1), "__id"), "__id", "__size", *tie)
    placed = placed.withColumn("__end", F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    met = placed.join(table, ["__index", "__shard"])
    begin = F.col("__end") - F.col("__size")
    inside = lambda x: F.least(F.greatest(F.col(x) - begin, F.lit(0)), F.col("__size"))
    return met.select(*carry, "__id", "__size", "__source_size", "__target", "__times", *(inside(x).alias(y) for x, y in (("__f", "__a"), ("__l", "__b"), ("__f2", "__c"), ("__l2", "__d"))))


def mixture(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 11) -> DataFrame:
    """(id, size, source_size, target, taken) for each row of ``docs``.

    Sources are weighed 1, 2, 3, 1, ... by code point, null last.  ``taken`` counts the words
    that the mix takes of the document, at most three times its size.  Texts that are
    null or have no words take part with size 0; repeated rows are rows of their own;
    an empty table gives an empty result; the same table and seed give the same mix."""
    m = _mixed(docs, id_col, source_col, text_col, [], seed)
    taken = F.col("__times") * F.col("__size") + F.greatest(F.col("__b") - F.col("__a"), F.lit(0)) + F.greatest(F.col("__d") - F.col("__c"), F.lit(0))
    return m.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken.alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 11) -> DataFrame:
    """The mix itself with the columns of ``docs``, whatever their names: a row for each time that a
    document is taken; where only some of its words are, the text is that excerpt.  Texts that
    are null or have no words are not taken; repeated rows are rows of their own, and rows
    without an id or a source take part; texts may be of any length; ties are settled by
    hashes and then by the rows; an empty table stays empty."""
    attach(docs.sparkSession)
    given, column = docs.schema, docs.columns.index(text_col)
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # whatever the columns are called
    names = list(at.values())
    docs = docs.toDF(*names)
    m = _mixed(docs, at[id_col], at[source_col], at[text_col], names, seed).select(*names, "__size", "__times", "__a", "__b", "__c", "__d")
    kind = given[text_col].dataType

    def run(batches):
        for whole_batch in batches:
            _, at, _ = kernel.string_buffers(whole_batch.column(column))
            for a, b in kernel.slices(at, OUTPUT_BYTES):
                yield from emitted(whole_batch.slice(a, b - a))

    def emitted(batch):
        """Rows of the mix: whole texts, and then excerpts."""
        base, extra = batch.columns[: len(names)], {c: np.asarray(batch.column(c)) for c in ("__size", "__times", "__a", "__b", "__c", "__d")}
        once_more = (extra["__b"] - extra["__a"] == extra["__size"]) & (extra["__size"] > 0)
        whole = pa.array(np.repeat(np.arange(batch.num_rows), extra["__times"] + once_more))
        if len(whole):
            yield pa.RecordBatch.from_arrays([c.take(whole) for c in base], names)
        parts = [(r, int(extra[x][r]), int(extra[y][r])) for x, y in (("__a", "__b"), ("__c", "__d")) for r in np.flatnonzero((extra[y] > extra[x]) & ~once_more).tolist()]
        if parts:
            texts = []
            for r, a, b in parts:
                data = base[column][r].as_py().encode()
                words = kernel.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), kernel.space_words())
                texts.append(data[words.start[a] : words.end[b - 1]].decode())
            picked = pa.array([r for r, _, _ in parts])
            out = [c.take(picked) for c in base]
            out[column] = pa.array(texts, pa.string()).cast(out[column].type)
            yield pa.RecordBatch.from_arrays(out, names)

    assert kind.simpleString() == "string", "the text column must be a string"
    return m.mapInArrow(kernel.tidy(run), docs.schema).toDF(*given.names)
