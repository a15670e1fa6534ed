"""MinHash near-duplicate removal with bottom-k sketches.

One hash function maps shingles to 63 bits; the k smallest values of a text are its
sketch.  Inverted lists of retained values give candidates, the sketch of the union
filters them, and the exact Jaccard index of the full shingle sets decides.

The lists stay short without losing links: texts with equal sets are one class; a class
is listed under its rarest retained values only, as many as a linked partner cannot
all lack (the prefix principle); lists are split by set size; and a list is compared
with one pivot first, after which only members of different components are left.  Those
of long lists meet in blocks of full sets, of which only links leave, not pairs.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import attach
from . import kernel
from .components import connected_components
from .storage import Scratch, few, keep

#: Standard deviations below the mean at which an overlap of sketches still counts.
SAFETY = 4.75
#: Lists with more members than this, not all of one component, are settled by full sets.
LONG_LIST = 64
#: Values of a block of full sets, about; two blocks meet in a task.
BLOCK_VALUES = 1 << 20
#: Pairs whose common values are counted at a time, and entries of inverted lists that are read for that.
PAIRS_AT_ONCE, ENTRIES_AT_ONCE = 1 << 21, 1 << 20


def sketch_texts(docs: DataFrame, id_col: str, text_col: str, width: int, k: int) -> DataFrame:
    """(id, n, sig, sketch): size of the shingle set, its 128-bit digest and its bottom k."""

    def run(batches):
        for batch in batches:
            raw, at, _ = kernel.string_buffers(batch.column(1))
            for a, b in kernel.slices(at):
                sets = list(kernel.shingle_sets(kernel.Words(raw, at[a : b + 1], kernel.space_words()), width))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        kernel.list_array([s[:k] for s in sets], pa.int64()),
                    ],
                    ["id", "n", "sig", "sketch"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(kernel.tidy(run), f"id {kind}, n bigint, sig binary, sketch array<bigint>")


def full_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, items): the whole shingle set of each text."""

    def run(batches):
        for batch in batches:
            raw, at, _ = kernel.string_buffers(batch.column(1))
            for a, b in kernel.slices(at):
                sets = list(kernel.shingle_sets(kernel.Words(raw, at[a : b + 1], kernel.space_words()), width))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), kernel.list_array(sets, pa.int64())], ["id", "items"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(kernel.tidy(run), f"id {kind}, items array<bigint>")


def expected_overlap(k: int, percent: int) -> int:
    """Values that the bottom-k sketches of two linked texts share at least, but for a chance
    of about one in a million at the threshold itself and far less above it."""
    p = percent / 100
    return max(1, math.floor(k * p - SAFETY * math.sqrt(k * p * (1 - p))))


def _listed(sets: DataFrame, k: int | None, percent: int, scratch: Scratch) -> DataFrame:
    """(h, band, rep, n, pos, whole, alone): inverted lists of ``sets`` (rep, n, values).

    A set's values are ranked from the rarest on; ``pos`` counts from 1, and values that no
    other set has come first without being listed.  Ranks go as far as a linked partner
    may lack values.  ``whole`` sets fit in their sketch, as their partners' then do
    (k None: all), and need no allowance for sampling.  Pairs whose sizes allow a
    link meet in a band."""
    entries = sets.select("rep", "n", F.explode("values").alias("h"))
    shared = scratch.keep(entries.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "shared")
    per = entries.join(shared, "h").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("m", "h"))).alias("hs"))
    n = F.col("n")
    whole, held, last = F.lit(True), n, n - F.ceil(n * percent / 100) + 1
    if k is not None:
        whole, held = n * 100 <= k * percent, F.least(n, F.lit(k))
        last = F.when(whole, last).otherwise(held - expected_overlap(k, percent) + 1)
    per = per.select("rep", "n", "hs", whole.alias("whole"), (held - F.size("hs")).cast("int").alias("alone"), last.cast("int").alias("last")).where("last > alone")
    step = math.log(1000 / (10 * percent - 1))
    band = F.floor(F.log(n.cast("double")) / step).cast("int")
    ranked = per.select("rep", "n", "whole", "alone", band.alias("at"), F.posexplode(F.slice("hs", F.lit(1), F.col("last") - F.col("alone"))).alias("i", "x"))
    return ranked.select(F.col("x.h").alias("h"), F.explode(F.array("at", F.col("at") - 1)).alias("band"), "rep", "n", (F.col("alone") + F.col("i") + 1).alias("pos"), "whole", "alone")


def _open(lists: DataFrame, comp: DataFrame, scratch: Scratch) -> DataFrame:
    """What is left of the lists: those with members of different components, with the
    component ``c`` of each entry and the list's length ``m``."""
    marked = scratch.keep(lists.join(comp.toDF("rep", "c"), "rep", "left").withColumn("c", F.coalesce("c", "rep")), "marked")
    ends = marked.groupBy("h", "band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m"))
    return scratch.keep(marked.join(scratch.keep(ends.where("lo <> hi").select("h", "band", "m"), "open"), ["h", "band"]), "left")


def _across(left: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of a list that lie in different components and may be linked.  Of two
    whole sets both ranks must allow the overlap that their sizes call for; and the smaller
    one must have enough values besides those that it is alone with.  So texts that are
    alike in less than a link calls for, as pages of one template are, make no pairs; nor
    do two members of the crowd, which blocks() compares."""
    side = lambda x: left.select("h", "band", *(F.col(c).alias(c + x) for c in ("rep", "n", "pos", "whole", "alone", "c", "crowd")))
    need = lambda m, n: F.ceil((F.col(m) + F.col(n)) * percent / (100 + percent))
    smaller = side("1").where(~F.col("whole1") | (need("n1", "n1") <= F.col("n1") - F.col("alone1")))
    ranks = (F.col("pos1") <= F.col("n1") - need("n1", "n2") + 1) & (F.col("pos2") <= F.col("n2") - need("n1", "n2") + 1)
    met = smaller.join(side("2"), ["h", "band"]).where("c1 <> c2 and not (crowd1 and crowd2) and (n1 < n2 or n1 = n2 and rep1 < rep2)").where(F.col("n1") * 100 >= percent * F.col("n2"))
    return met.where(~(F.col("whole1") & F.col("whole2")) | ranks).select(F.col("rep1").alias("a"), F.col("rep2").alias("b")).distinct()


def spanning_links(values: np.ndarray, at: np.ndarray, label: np.ndarray, side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Linked pairs of sets, ``values[at[i]:at[i + 1]]`` each, as few as tie together all labels that
    links between sets of different labels do; with ``side``, between sets of different sides.

    Common values are counted by inverted lists; of a value that most sets have, the list has
    those that lack it, so a crowd that is alike costs little more than its differences."""
    rows, n = len(at) - 1, np.diff(at)
    code = np.unique(values, return_inverse=True)[1]
    row = np.repeat(np.arange(rows), n)
    have = np.bincount(code)
    most = np.flatnonzero(have * 2 > rows)
    lacking = np.ones((len(most), rows), bool)
    place = np.full(len(have), -1)
    place[most] = np.arange(len(most))
    own = place[code]
    lacking[own[own >= 0], row[own >= 0]] = False
    entry = np.concatenate([row[np.argsort(code, kind="stable")], np.nonzero(lacking)[1]])
    length = have.copy()
    start = np.cumsum(have) - have
    length[most] = rows - have[most]
    start[most] = len(code) + np.cumsum(length[most]) - length[most]
    sums = lambda x: np.append(0, np.cumsum(x))[at]
    common, cost = np.diff(sums(own >= 0)), np.diff(sums(length[code]))
    root = {x: x for x in np.unique(label).tolist()}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def counted(asked, of):
        """How many list entries of the values ``of`` each asked set leads to each set."""
        which = np.concatenate([np.arange(at[i], at[i + 1]) for i in asked])
        who = np.repeat(np.arange(len(asked)), n[asked])[of[which]]
        which = code[which[of[which]]]
        many = length[which]
        met = entry[np.repeat(start[which] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        return np.bincount(np.repeat(who, many) * rows + met, minlength=len(asked) * rows).reshape(len(asked), rows)

    # Of two sets with different labels one is not of the most frequent label; neither has too many values for itself.
    names, code_of_label = np.unique(label, return_inverse=True)
    largest = names[np.bincount(code_of_label).argmax()]
    able = np.diff(sums(have[code] > 1)) * 100 >= percent * n
    asked, links, a = np.flatnonzero(able & (label != largest)), [], 0
    upto = np.cumsum(cost[asked])
    while a < len(asked):
        z = max(a + 1, min(a + PAIRS_AT_ONCE // rows, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + ENTRIES_AT_ONCE, "right"))))
        some = asked[a:z]
        both = counted(some, own < 0) - counted(some, own >= 0) + common[some, None]
        linked = (both * (100 + percent) >= percent * (n[some, None] + n)) & (label[some, None] != label)
        if side is not None:
            linked &= side[some, None] != side
        x, y = np.nonzero(linked)
        x = some[x]
        for k in np.unique(np.stack([label[x], label[y]]), axis=1, return_index=True)[1].tolist():
            u, v = find(int(label[x[k]])), find(int(label[y[k]]))
            if u != v:
                root[u] = v
                links.append((int(x[k]), int(y[k])))
        if len(x):
            label = np.array([find(i) for i in names.tolist()])[code_of_label]
        a = z
    return links


def _by_blocks(sets: DataFrame, left: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): links that tie together what links between different components of the crowd do.

    ``sets`` is (rep, n, values), ``left`` its open lists.  Members that lists lead to from one to the
    other are a group, which is dealt out to blocks; two blocks at a time meet in a task."""
    alike = F.ceil(F.col("n") * 2 * percent / (100 + percent)) <= F.col("n") - F.col("alone")
    lists = scratch.keep(left.groupBy("h", "band").agg(F.min("rep").alias("first"), F.bool_or(alike).alias("alike")).where("alike").select("h", "band", "first"), "crowd-ends")
    group = connected_components(left.join(lists, ["h", "band"]).select("rep", "first").distinct(), "rep", "first", scratch).toDF("rep", "g")
    of = scratch.keep(left.select("rep", "n", "c").distinct().join(group, "rep"), "crowd-groups")
    blocks = scratch.keep(of.groupBy("g").agg(F.ceil(F.sum("n") / BLOCK_VALUES).cast("int").alias("k")), "crowd-blocks")
    own = of.join(blocks, "g").withColumn("i", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int")).drop("n")
    met = sets.select("rep", "values").join(own, "rep").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    met = met.select("g", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "rep", "c", "i", "values")

    def run(table):
        table = table.combine_chunks()
        label = table["c"].combine_chunks().dictionary_encode()
        label = (label.combine_chunks() if isinstance(label, pa.ChunkedArray) else label).indices.to_numpy(zero_copy_only=False)
        lists = table["values"].combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        at = lists.offsets.to_numpy().astype(np.int64)
        side = table["i"].to_numpy() if table["lo"][0].as_py() != table["hi"][0].as_py() else None
        found = spanning_links(lists.values.to_numpy()[at[0] : at[-1]], at - at[0], label, side, percent)
        return pa.Table.from_arrays([table["rep"].take(pa.array([x[i] for x in found], pa.int64())) for i in (0, 1)], ["a", "b"])

    kind = sets.schema["rep"].dataType.simpleString()
    return scratch.keep(met.groupBy("g", "lo", "hi").applyInArrow(run, f"a {kind}, b {kind}"), "crowd-links")


def _only(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in the stored one-column table ``ids``."""
    return df.join(few(ids.toDF(key)), key, "left_semi")


def _members(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.keep(pairs.select("a").union(pairs.select("b")).distinct(), "members")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that are linked.  The sketch of the union filters, full sets decide."""
    sk = scratch.keep(_only(classes.select("rep", "n", "sketch"), "rep", _members(pairs, scratch)), "pair-sketches")
    met = pairs.join(sk.toDF("a", "na", "sa"), "a").join(sk.toDF("b", "nb", "sb"), "b")
    common = F.array_intersect("sa", "sb")
    hits = F.size(F.array_intersect(common, F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)))
    whole = (F.col("na") <= k) & (F.col("nb") <= k)
    exact = F.size(common) * 100 >= percent * (F.col("na") + F.col("nb") - F.size(common))
    met = scratch.keep(met.where(F.when(whole, exact).otherwise(hits >= expected_overlap(k, percent))).select("a", "b", whole.alias("whole")), "likely")
    rest = met.where("not whole").select("a", "b")
    sets = scratch.keep(full_sets(_only(docs.select(id_col, text_col), id_col, _members(rest, scratch)), id_col, text_col, width), "sets")
    common = F.size(F.array_intersect("xa", "xb"))
    sure = rest.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b").where(common * 100 >= percent * (F.size("xa") + F.size("xb") - common)).select("a", "b")
    return scratch.keep(met.where("whole").select("a", "b").union(sure).distinct(), "links")


def _same_id(own: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): classes that rows of one id belong to, linked by the first of them."""
    many = scratch.keep(own.where("id is not null").groupBy("id").agg(F.count_distinct("sig").alias("m")).where("m > 1").select("id"), "repeated-ids")
    reps = scratch.keep(_only(own.select("id", "sig"), "id", many).join(classes.select("sig", "rep"), "sig").select("id", "rep").distinct(), "reps-of-ids")
    return reps.join(reps.groupBy("id").agg(F.min("rep").alias("a")), "id").where("a <> rep").select("a", F.col("rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, k: int = 64) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a text's set is its
    distinct ``width``-word shingles, or its whole word sequence if that is shorter.
    Texts are linked whose sets have 100 * intersection >= percent * union.
    component_id is the smallest id that links lead to, itself included.

    Texts without words and null texts have an empty set and no links; a text may be of any
    length.  Rows without an id get a null component and are kept.  Repeated rows of one id
    are one document, whose texts tie together what each is linked with.  An empty table
    gives an empty result; other columns, whatever their names, are not read."""
    attach(docs.sparkSession)
    scratch = Scratch()
    own = keep(sketch_texts(docs, id_col, text_col, width, k), "sketches")
    classes = scratch.keep(own.where("n > 0 and id is not null").groupBy("sig").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.min_by("sketch", "id").alias("sketch")), "classes")
    lists = scratch.keep(_listed(classes.select("rep", "n", F.col("sketch").alias("values")), k, percent, scratch), "lists")
    check = lambda pairs: _verified(pairs, classes, docs, id_col, text_col, width, k, percent, scratch)
    forest = lambda comp: comp.select(F.col("node").alias("a"), F.col("component").alias("b"))

    # Each list against the member with the fewest values of its own.
    pivots = scratch.keep(lists.groupBy("h", "band").agg(F.min(F.struct("alone", "n", "rep")).alias("p")).select("h", "band", F.col("p.n").alias("np"), F.col("p.rep").alias("p")), "pivots")
    star = lists.join(pivots, ["h", "band"]).where("rep <> p").where(F.least("n", "np") * 100 >= percent * F.greatest("n", "np"))
    tried = scratch.keep(star.select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b")).distinct(), "tried")
    links = check(tried)
    comp = scratch.keep(connected_components(links.union(_same_id(own, classes, scratch)), scratch=scratch), "components")

    # Members of different components: in short lists pairs by the same ranks, in long ones blocks of their full sets.
    left = _open(lists, comp, scratch)
    crowd = scratch.keep(left.where(F.col("m") > LONG_LIST).select("rep").distinct(), "crowd")
    short, dense = left.where(F.col("m") <= LONG_LIST), None
    if crowd.isEmpty():
        short = short.withColumn("crowd", F.lit(False))
    else:
        sets = full_sets(_only(docs.select(id_col, text_col), id_col, crowd), id_col, text_col, width)
        sets = scratch.keep(sets.select(F.col("id").alias("rep"), F.size("items").cast("bigint").alias("n"), F.col("items").alias("values")), "crowd-sets")
        exact = _open(scratch.keep(_listed(sets, None, percent, scratch), "crowd-lists"), comp, scratch)
        dense = _by_blocks(sets, exact, percent, scratch)
        short = short.join(few(crowd).withColumn("crowd", F.lit(True)), "rep", "left").fillna(False, ["crowd"])
    more = _across(short, percent)
    more = scratch.keep(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(tried, ["a", "b"], "left_anti"), "more")
    links = check(more)
    links = links if dense is None else links.union(dense)
    if not links.isEmpty():
        comp = scratch.keep(connected_components(forest(comp).union(links), scratch=scratch), "components")
    found = classes.select("sig", "rep").join(comp.toDF("rep", "c"), "rep", "left").select("sig", F.coalesce("c", "rep").alias("c"))
    found = keep(found, "found")
    scratch.clear()
    out = own.join(found, "sig", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, k: int = 64) -> DataFrame:
    """One row of each group of near duplicates, with all columns of ``docs``: that of the smallest
    id, and of rows that repeat this id the one whose text has the least hash.  Rows without
    an id stay.  Columns may have any names."""
    scratch = Scratch()
    found = near_duplicates(docs, id_col, text_col, width, percent, k)
    found = scratch.keep(found.select(F.col(id_col).alias("id"), "kept").where("id is not null").groupBy("id").agg(F.max("kept").alias("kept"), F.count("*").alias("m")), "kept")
    gone = scratch.keep(found.where("not kept").select(F.col("id").alias(id_col)), "gone")
    left = docs.join(few(gone), id_col, "left_anti").select(docs.columns)
    many = scratch.keep(found.where("kept and m > 1").select(F.col("id").alias(id_col)), "many")
    if many.isEmpty():
        return left
    at = next(x for x in ("__at" + "_" * i for i in range(len(docs.columns) + 1)) if x not in {c.lower() for c in docs.columns})
    order = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col), text_col)
    one = _only(left, id_col, many).withColumn(at, F.row_number().over(order)).where(F.col(at) == 1).select(docs.columns)
    return left.join(few(many), id_col, "left_anti").select(docs.columns).union(one)
