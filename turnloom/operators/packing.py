"""Packing evidence into turn and token budgets, per query.

A pack is a fold over a query's offers: each offer is taken if its lane's limit of turns, the token budget
and what was taken before allow it, else passed over.  What differs between the packs is only which offers
are made, and in which order.  A query's offers are bounded by the search that made them.  A turn without
a token cost is never taken; ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STATE = "struct<got:array<struct<id:bigint,used:bigint>>,covered:array<string>,tokens:bigint>"


def _unpacked(packs: DataFrame) -> DataFrame:
    """(query_id, id, place, used_tokens) from a query's ``got``."""
    return packs.select("query_id", F.posexplode("got").alias("k", "x")).select("query_id", F.col("x.id").alias("id"), (F.col("k") + 1).cast("int").alias("place"), F.col("x.used").alias("used_tokens"))


def packed(offers: DataFrame, max_turns: int, max_tokens: int) -> DataFrame:
    """The fold over offers (query_id, lane, slot, rank, id, token_cost, slots, most): in order of lane, slot and rank.

    ``most`` is the number of turns up to which the lane may fill the pack; an offer for a ``slot`` is void
    once the slot is covered.
    """
    offer = F.struct("lane", F.coalesce("slot", F.lit("")).alias("slot"), "rank", "id", F.col("token_cost").cast("bigint").alias("cost"), F.coalesce("slots", F.array().cast("array<string>")).alias("slots"), F.col("most").cast("int").alias("most"))

    def step(s: Column, x: Column) -> Column:
        room = (F.size(s["got"]) < F.least(x["most"], F.lit(max_turns))) & (s["tokens"] + x["cost"] <= max_tokens)
        fresh = ~F.exists(s["got"], lambda g: g["id"] == x["id"]) & ((x["slot"] == "") | ~F.array_contains(s["covered"], x["slot"]))
        tokens = s["tokens"] + x["cost"]
        taken = F.struct(F.array_append(s["got"], F.struct(x["id"].alias("id"), tokens.alias("used"))).alias("got"), F.array_union(s["covered"], x["slots"]).alias("covered"), tokens.alias("tokens"))
        return F.when(room & fresh, taken.cast(_STATE)).otherwise(s)

    none = F.struct(F.array().alias("got"), F.array().alias("covered"), F.lit(0).alias("tokens")).cast(_STATE)
    return _unpacked(offers.groupBy("query_id").agg(F.array_sort(F.collect_list(offer)).alias("offers")).select("query_id", F.aggregate("offers", none, step)["got"].alias("got")))


def _offers(rows: DataFrame, lane: int, most: int, first: list[Column] = (), slot: Column | None = None) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*first, F.col("fused").desc(), "id")
    return rows.select("query_id", F.lit(lane).alias("lane"), (F.lit(None).cast("string") if slot is None else slot).alias("slot"), F.row_number().over(w).alias("rank"), "id", "token_cost", "slots", F.lit(most).alias("most"))


def pack_rank(rows: DataFrame, max_turns: int, max_tokens: int, reserve: int = 0) -> DataFrame:
    """By fused score; up to ``reserve`` mandatory turns go first, a turn too long for what is left is passed over."""
    every = _offers(rows, 1, max_turns)
    return packed(_offers(rows.where("mandatory"), 0, reserve).unionByName(every) if reserve else every, max_turns, max_tokens)


def pack_units(rows: DataFrame, max_turns: int, max_tokens: int) -> DataFrame:
    """Mandatory turns first, each group by fused score."""
    return packed(_offers(rows, 0, max_turns, [F.col("mandatory").desc()]), max_turns, max_tokens)


def pack_obligation(rows: DataFrame, max_turns: int, max_tokens: int, floor: int = 4) -> DataFrame:
    """A floor by rank, then for each open slot the best turn that fits, then by rank."""
    every = _offers(rows, 2, max_turns)
    base = every.where(F.col("rank") <= floor).withColumn("lane", F.lit(0))
    slots = every.withColumns({"lane": F.lit(1), "slot": F.explode("slots")})
    return packed(base.unionByName(slots).unionByName(every), max_turns, max_tokens)


def pack_set_cover(rows: DataFrame, max_turns: int, max_tokens: int, diversity: Column | float = 0.2) -> DataFrame:
    """Turn by turn the highest utility: fused score, 1.25 per slot still open, ``diversity`` for a new session, less 0.0005 a token.

    ``diversity`` is 0.9 where the question asks for a list or a count.  Of equal utilities the higher score, then the greater id.
    """
    new = diversity if isinstance(diversity, Column) else F.lit(diversity)
    item = F.struct("id", "fused", F.col("token_cost").cast("bigint").alias("cost"), F.coalesce("slots", F.array().cast("array<string>")).alias("slots"), F.coalesce("session_id", F.lit("")).alias("session"), new.cast("double").alias("new"))
    per = rows.where("token_cost is not null").groupBy("query_id").agg(F.collect_list(item).alias("items"))
    left = "array<struct<id:bigint,fused:double,cost:bigint,slots:array<string>,session:string,new:double>>"
    shape = f"struct<left:{left},got:array<struct<id:bigint,used:bigint>>,covered:array<string>,sessions:array<string>,tokens:bigint>"

    def step(s: Column, _: Column) -> Column:
        gain = lambda x: x["fused"] + 1.25 * F.size(F.array_except(x["slots"], s["covered"])) + F.when(F.array_contains(s["sessions"], x["session"]), 0.0).otherwise(x["new"]) - 0.0005 * x["cost"]
        best = F.array_max(F.transform(s["left"], lambda x: F.struct(F.round(gain(x), 9).alias("utility"), x["fused"].alias("fused"), x["id"].alias("id"), x.alias("x"))))["x"]

        def after(b: Column) -> Column:
            rest, tokens = F.filter(s["left"], lambda x: x["id"] != b["id"]), s["tokens"] + b["cost"]
            fits = F.struct(rest.alias("left"), F.array_append(s["got"], F.struct(b["id"].alias("id"), tokens.alias("used"))).alias("got"), F.array_union(s["covered"], b["slots"]).alias("covered"), F.array_union(s["sessions"], F.array(b["session"])).alias("sessions"), tokens.alias("tokens"))
            passed = F.struct(rest.alias("left"), s["got"].alias("got"), s["covered"].alias("covered"), s["sessions"].alias("sessions"), s["tokens"].alias("tokens"))
            return F.when(tokens <= max_tokens, fits.cast(shape)).otherwise(passed.cast(shape))

        done = (F.size(s["left"]) == 0) | (F.size(s["got"]) >= max_turns)
        return F.when(done, s).otherwise(F.element_at(F.transform(F.array(best), after), 1))

    start = F.struct(F.col("items").alias("left"), F.array().alias("got"), F.array().alias("covered"), F.array().alias("sessions"), F.lit(0).alias("tokens")).cast(shape)
    return _unpacked(per.select("query_id", F.aggregate(F.sequence(F.lit(1), F.size("items")), start, step)["got"].alias("got")))


def pack_render(rows: DataFrame, max_tokens: int) -> DataFrame:
    """(query_id, id, place): the longest prefix by rank whose tokens fit; mandatory turns rank first and so are dropped last."""
    w = Window.partitionBy("query_id").orderBy(F.col("mandatory").desc(), F.col("fused").desc(), "id")
    run = F.sum("token_cost").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("query_id", "id", F.row_number().over(w).alias("place"), run.alias("used_tokens")).where(F.col("used_tokens") <= max_tokens)
