"""Building the memory graph: scenes, aliases, rare terms, relation signals, clusters, hierarchies, checks of extracted rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.plans.lineage import cut, ranked

# Thresholds of relation signals and how a signal's value becomes a gate score (base, slope).
THRESHOLDS = {"SCENE_SIMILAR": 0.72, "SHARED_ENTITY": 0.25, "STATE_COMPATIBLE": 0.45, "COLLECTION_RELATED": 0.45, "TEMPORAL_NEAR": math.exp(-2.0), "LEXICAL_RARE": 0.50}
GATES = {"SCENE_SIMILAR": (0.0, 1.0), "SHARED_ENTITY": (0.82, 0.16), "STATE_COMPATIBLE": (0.80, 0.18), "COLLECTION_RELATED": (0.58, 0.18), "TEMPORAL_NEAR": (0.54, 0.20), "LEXICAL_RARE": (0.82, 0.16)}
#: Owners of a block of ``sparse_pairs``, and columns of its matrices at a time.
OWNERS, CODES = 1024, 4096
#: Rows up to which a table of ``sparse_pairs`` is broadcast.
SMALL = 10_000


def _turn_signals(turns: DataFrame, high: int, threshold: float, block: int) -> DataFrame:
    """Turns in blocks of their session, with ``quiet`` (the topic turns and nobody is answered) and ``back`` (how many turns ago a name of this turn last fell, up to ``high``).

    A block begins with copies of the ``high`` turns before it, so signals do not end at its border.
    """
    by = ["memory_id", "session_id"]
    placed = ranked(turns, by, [F.col("turn_index").asc_nulls_last(), F.col("turn_no")]).withColumn("block", F.floor((F.col("rank") - 1) / block).cast("int"))
    again = placed.where(F.pmod(F.col("rank") - 1, F.lit(block)) >= block - high).withColumn("block", F.col("block") + 1)
    rows = placed.withColumn("own", F.lit(True)).unionByName(again.withColumn("own", F.lit(False)))
    w = Window.partitionBy(*by, "block").orderBy("rank")
    ago = lambda c, k: F.lag(c, k).over(w)
    recent = F.array_union(F.coalesce(ago("terms", 1), F.array().cast("array<string>")), F.coalesce(ago("terms", 2), F.array().cast("array<string>")))
    near = F.size(F.array_intersect("terms", recent)) / F.greatest(F.size(F.array_union("terms", recent)), F.lit(1))
    answers = F.coalesce((ago("role", 1) != F.col("role")) & (ago("listener", 1) == F.col("speaker")), F.lit(False))
    back = F.coalesce(*[F.when(F.arrays_overlap("names", ago("names", k)), k) for k in range(1, high + 1)])
    return rows.withColumns({"quiet": (near < threshold) & ~answers, "back": back}).where("own").select(*by, "block", "rank", "turn_no", "quiet", "back")


def segment(turns: DataFrame, low: int = 4, high: int = 12, threshold: float = 0.55, block: int = 4096) -> DataFrame:
    """(memory_id, session_id, turn_no, scene): scenes of ``low`` to ``high`` turns, cut where the topic turns.

    ``turns`` has terms and names arrays.  A scene ends at ``high`` turns, or from ``low`` on where the next
    turn shares under ``threshold`` of the terms of the last two, no name of the scene, and answers nobody.
    A short last scene joins the one before if both fit.

    The only state between turns is the length of the scene at hand.  So each block is folded once from every
    length it may be entered with, the blocks' results are chained to find the true one, and a second fold
    from it marks the cuts: no session is walked in one task.
    """
    by = ["memory_id", "session_id"]
    signals = cut(_turn_signals(turns, high, threshold, block))

    def length(now: Column, x: Column) -> Column:
        ends = (now >= high) | ((now >= low) & x["quiet"] & (x["back"].isNull() | (x["back"] > now)))
        return F.when(ends, F.lit(1)).otherwise(now + 1)

    blocks = signals.groupBy(*by, "block").agg(F.array_sort(F.collect_list(F.struct("rank", "turn_no", "quiet", "back"))).alias("turns"))
    maps = blocks.select("*", F.transform(F.sequence(F.lit(0), F.lit(high)), lambda n: F.aggregate("turns", n, length)).alias("leads_to"))
    earlier = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    entered = maps.withColumn("entry", F.aggregate(F.collect_list("leads_to").over(earlier), F.lit(0), lambda n, m: F.element_at(m, n + 1)))
    walked = F.aggregate("turns", F.array(F.col("entry")), lambda got, x: F.array_append(got, length(F.element_at(got, -1), x)))
    rows = entered.select(*by, "block", F.explode(F.arrays_zip(F.col("turns.turn_no").alias("turn_no"), F.col("turns.rank").alias("rank"), F.slice(walked, F.lit(2), F.size("turns")).alias("length"))).alias("x"))
    rows = cut(rows.select(*by, "block", "x.*").withColumn("starts", (F.col("length") == 1).cast("int")))
    opened = rows.groupBy(*by, "block").agg(F.sum("starts").alias("n"))
    opened = opened.select(*by, "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.sum("starts").over(Window.partitionBy(*by, "block").orderBy("rank"))
    scenes = rows.withColumn("inside", inside).join(opened, [*by, "block"]).select(*by, "turn_no", (F.col("before") + F.col("inside") - 1).cast("int").alias("scene"))
    sizes = scenes.groupBy(*by, "scene").agg(F.count(F.lit(1)).alias("n"))
    last = sizes.groupBy(*by).agg(F.max("scene").alias("last"))
    ends = sizes.join(last, by).where("scene >= last - 1").groupBy(*by, "last").agg(F.sum("n").alias("both"), F.max(F.when(F.col("scene") == F.col("last"), F.col("n"))).alias("tail"))
    joined = ends.where((F.col("last") > 0) & (F.col("tail") < low) & (F.col("both") <= high)).select(*by, F.col("last").alias("scene"), F.lit(1).alias("joins"))
    return scenes.join(joined, [*by, "scene"], "left").select(*by, "turn_no", (F.col("scene") - F.coalesce("joins", F.lit(0))).cast("int").alias("scene"))


def rare_terms(terms: DataFrame, share: float = 0.1) -> DataFrame:
    """(memory_id, term, df): terms of (memory_id, session_id, term) in two sessions at least and ``share`` of them at most (or two)."""
    w = cut(terms.distinct())
    n = w.select("memory_id", "session_id").distinct().groupBy("memory_id").agg(F.count(F.lit(1)).alias("sessions"))
    df = w.groupBy("memory_id", "term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(n, "memory_id").where((F.col("df") >= 2) & (F.col("df") <= F.greatest(F.lit(2), F.floor(F.col("sessions") * share)))).select("memory_id", "term", "df")


def alias_groups(surfaces: DataFrame, key: Column, low: int = 2, share: float = 0.5) -> DataFrame:
    """(memory_id, key, forms): spellings of (memory_id, session_id, surface) that fold to one key over ``low`` sessions or more, but not over most."""
    s = surfaces.withColumn("key", key).where(F.length("key") >= 3)
    n = surfaces.select("memory_id", "session_id").distinct().groupBy("memory_id").agg(F.count(F.lit(1)).alias("sessions"))
    g = s.groupBy("memory_id", "key").agg(F.count_distinct("session_id").alias("spread"), F.array_sort(F.collect_set(F.lower("surface"))).alias("forms"))
    ceiling = F.greatest(F.lit(low), F.floor(F.col("sessions") * share))
    return g.join(n, "memory_id").where((F.col("spread") >= low) & (F.col("spread") <= ceiling) & (F.size("forms") >= 2)).select("memory_id", "key", "forms")


def signal_mask(scores: dict[str, Column]) -> Column:
    """Names of the signals that reach their threshold, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(0.0)) >= THRESHOLDS[n], F.lit(n)) for n, c in scores.items()])))


def gate_score(scores: dict[str, Column]) -> Column:
    """Highest routing confidence that any present signal gives."""
    return F.coalesce(F.greatest(*[GATES[n][0] + GATES[n][1] * c for n, c in scores.items()], F.lit(0.0)), F.lit(0.0))


def validate_extracted(rows: DataFrame, cap: int = 16) -> DataFrame:
    """Extracted facts with ``problem``: a missing field, a confidence outside 0 to 1, or a place over the scene's cap; null if fine."""
    w = Window.partitionBy("scene_id").orderBy(F.col("confidence").desc_nulls_last(), "fact_no")
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    return rows.withColumn(
        "problem",
        F.when(blank("owner"), "owner").when(blank("predicate"), "predicate").when(blank("value"), "value").when(F.coalesce(F.size("evidence"), F.lit(0)) < 1, "evidence")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence").when(F.row_number().over(w) > cap, "cap"),
    )


def resolve_span(quote: Column, value: Column, text: Column) -> Column:
    """struct(start, end, how) of a quote, else of the value, in a text, without regard to case; null if neither stands there."""
    low = F.lower(text)
    at_quote = F.instr(low, F.lower(quote))
    at_value = F.instr(low, F.lower(value))
    return F.when((at_quote > 0) & (F.length(quote) > 0), F.struct((at_quote - 1).alias("start"), (at_quote - 1 + F.length(quote)).alias("end"), F.lit("quote").alias("how"))).when(
        (at_value > 0) & (F.length(value) > 0), F.struct((at_value - 1).alias("start"), (at_value - 1 + F.length(value)).alias("end"), F.lit("value").alias("how"))
    )


def merge_facts(rows: DataFrame) -> DataFrame:
    """Facts equal in owner, predicate, value, polarity and evidence as one: highest confidence, all unit ids, the first id."""
    return rows.groupBy("owner", "predicate", "value", "polarity", "evidence").agg(F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("unit_ids")))).alias("unit_ids"), F.min("fact_no").alias("fact_no"))


def uncovered_units(units: DataFrame, facts: DataFrame) -> DataFrame:
    """Units (turn_no, unit_id, start, end) that no fact span (turn_no, start, end) of the turn meets."""
    f = facts.select("turn_no", F.col("start").alias("f0"), F.col("end").alias("f1"))
    met = units.join(f, "turn_no").where("start < f1 and f0 < end").select("unit_id")
    return units.join(met, "unit_id", "left_anti")


def grouped_hierarchy(leaves: DataFrame, fanout: int, sign: str | None = None) -> DataFrame:
    """(memory_id, parent_id, child_id, level) of a tree over (memory_id, leaf_id), ``fanout`` to a parent, up to one root per memory.

    Leaves stand in order of ``sign`` (null last), a column that is alike for leaves that belong together, then
    of id; a card holds the next ``fanout`` of the level below.  So a leaf's place tells its card on every level.
    """
    rows = leaves.select("memory_id", "leaf_id", F.lit(0).alias("_s") if sign is None else F.col(sign).alias("_s")).distinct()
    at = ranked(rows, ["memory_id"], [F.col("_s").asc_nulls_last(), F.col("leaf_id")], "place")
    total = at.groupBy("memory_id").agg(F.count(F.lit(1)).alias("n"))
    levels = F.lit(1)
    for k in range(1, 20):
        levels = levels + (F.lit(fanout**k) < F.col("n")).cast("int")
    card = lambda k, width: F.concat(F.lit("card"), F.lpad(k.cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor((F.col("place") - 1) / width).cast("string"), 9, "0"))
    per = at.join(total, "memory_id").select("*", F.explode(F.sequence(F.lit(1), levels)).alias("level"))
    width = F.pow(F.lit(float(fanout)), F.col("level")).cast("bigint")
    below = F.pow(F.lit(float(fanout)), F.col("level") - 1).cast("bigint")
    first = per.where(F.pmod(F.col("place") - 1, below) == 0)
    return first.select("memory_id", card(F.col("level"), width).alias("parent_id"), F.when(F.col("level") == 1, F.col("leaf_id")).otherwise(card(F.col("level") - 1, below)).alias("child_id"), "level")


def _counted(block: pa.Table, least: int) -> pa.Table:
    """Pairs of the owners of two blocks (of one, where ``a`` is ``b``) with ``least`` common codes or more, counted by products of 0-1 matrices."""
    memory, a, b = (block.column(c)[0].as_py() for c in ("memory_id", "a", "b"))
    owners, side, codes = block.column("owner_id").to_pylist(), block.column("block").to_numpy(), block.column("codes").combine_chunks()
    place = np.empty(len(owners), "i8")
    place[order := np.array(sorted(range(len(owners)), key=owners.__getitem__), "i8")] = np.arange(len(owners))
    names = pa.array([owners[i] for i in order], pa.string())
    row = np.repeat(np.arange(len(owners)), codes.value_lengths().to_numpy())
    _, code = np.unique(codes.flatten().to_numpy(), return_inverse=True)
    left, right = (np.flatnonzero(side == x) for x in (a, b))
    left, right = left[np.argsort(place[left])], right[np.argsort(place[right])]
    # A code that only one block holds, or only one owner, is in no pair.
    n = [np.bincount(code[side[row] == x], minlength=code.max() + 1) for x in (a, b)]
    common = np.flatnonzero(np.minimum(*n) > (a == b))
    column = np.full(len(n[0]), -1, "i8")
    column[common] = np.arange(len(common))
    column = column[code]

    def matrix(rows: np.ndarray, low: int) -> np.ndarray:
        at = np.full(len(owners), -1, "i8")
        at[rows] = np.arange(len(rows))
        here = (at[row] >= 0) & (column >= low) & (column < low + CODES)
        m = np.zeros((len(rows), min(CODES, len(common) - low)), "f4")
        m[at[row[here]], column[here] - low] = 1
        return m

    shared = np.zeros((len(left), len(right)), "f4")
    for low in range(0, len(common), CODES):
        shared += matrix(left, low) @ matrix(right, low).T
    out = []
    for low in range(0, len(left), 64):
        part = shared[low : low + 64]
        i, j = np.nonzero(part >= least)
        if a == b:
            i, j = i[i + low < j], j[i + low < j]
        p, q = place[left[i + low]], place[right[j]]
        columns = [pa.repeat(pa.scalar(memory, pa.string()), len(i)), names.take(pa.array(np.minimum(p, q))), names.take(pa.array(np.maximum(p, q))), pa.array(part[i, j].astype("i8"))]
        out.append(pa.record_batch(columns, ["memory_id", "owner_id", "other_id", "shared"]))
    return pa.Table.from_batches(out, pa.schema([("memory_id", pa.string()), ("owner_id", pa.string()), ("other_id", pa.string()), ("shared", pa.int64())]))


def sparse_pairs(held: DataFrame, least: int) -> DataFrame:
    """(memory_id, owner_id, other_id, shared): pairs of owners of a memory who share ``least`` values or more of ``held`` (memory_id, owner_id, value_key).

    Two such owners share one of either's rarest values, all but ``least`` - 1 of its own.  Owners are cut into
    blocks by hash; an owner's values go once to every block where one of its rarest is held, whatever the number
    of owners there, and blocks are compared as wholes: pairs are made where they are written and never shuffled.
    """
    rows = held.where("memory_id is not null and owner_id is not null and value_key is not null").repartition("memory_id", "owner_id").distinct()
    sets = cut(rows.groupBy("memory_id", "owner_id").agg(F.collect_list("value_key").alias("v")).where(F.size("v") >= least))
    small = lambda df: F.broadcast(df) if df.count() <= SMALL else df
    blocks = cut(sets.groupBy("memory_id").agg(F.ceil(F.count(F.lit(1)) / OWNERS).alias("blocks")))
    block = F.pmod(F.xxhash64("owner_id"), F.col("blocks")).cast("int")
    one = sets.join(small(blocks), "memory_id").select("memory_id", "owner_id", block.alias("block"), F.explode("v").alias("value_key"))
    where = one.groupBy("memory_id", "value_key", "block").agg(F.count(F.lit(1)).alias("n")).groupBy("memory_id", "value_key").agg(F.sum("n").alias("df"), F.collect_list("block").alias("to"))
    where = cut(where).withColumn("code", F.monotonically_increasing_id())
    known = one.join(small(where), ["memory_id", "value_key"]).groupBy("memory_id", "owner_id", "block").agg(F.array_sort(F.collect_list(F.struct("df", "code", "to"))).alias("v"))
    rarest = F.slice("v", F.lit(1), F.size("v") - (least - 1))
    sent = known.select("memory_id", "owner_id", "block", F.transform("v", lambda x: x["code"]).alias("codes"), F.explode(F.array_distinct(F.flatten(F.transform(rarest, lambda x: x["to"])))).alias("to"))
    meet = sent.select("memory_id", F.least("block", "to").alias("a"), F.greatest("block", "to").alias("b"), "owner_id", "block", "codes")
    return meet.groupBy("memory_id", "a", "b").applyInArrow(lambda t: _counted(t, least), "memory_id string, owner_id string, other_id string, shared bigint")
