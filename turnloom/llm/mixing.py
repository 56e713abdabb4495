"""Operator: documents of several sources mixed to target shares of all tokens.

Each source's budget is filled with whole passes over it and a rest.  The rest is a bounded subset sum:
documents are counted by exact token length, lengths are taken in proportion to their counts, then from
the longest down, and a dynamic programme over the last tokens finds counts that meet the budget exactly
where any do.  Which documents of a length are used is settled by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.tokens import FOLDER, RANKS, REMEMBERED, encoder, label
from turnloom.plans.lineage import cut

#: Tokens the dynamic programme spans; hash buckets in which documents of one length are ranked.
SPAN, BUCKETS = 50_000, 1024
MAX_SOURCES = 10_000


def fit_counts(length: np.ndarray, have: np.ndarray, budget: int, span: int = SPAN) -> np.ndarray:
    """How many documents of each length to take: at most ``have``, together ``budget`` tokens or as near below as found."""
    take = np.zeros(len(length), "i8")
    whole = int((length * have).sum())
    if whole <= budget:
        return have.astype("i8")
    if whole:
        take = np.floor(have * (budget / whole)).astype("i8")
    rest = budget - int((length * take).sum())
    while rest < 0:  # the division can round up on huge counts
        k = int(np.flatnonzero(take)[-1])
        take[k] -= 1
        rest += int(length[k])
    for k in np.argsort(-length, kind="stable"):
        if rest > span:
            more = min(int(have[k] - take[k]), (rest - span // 2) // int(length[k]))
            if more > 0:
                take[k] += more
                rest -= more * int(length[k])
    # Sums that can be reached, as bits of a number; what made each step is kept to walk back.
    reach, steps, full = 1, [], (1 << (rest + 1)) - 1
    for k in np.argsort(length, kind="stable")[::-1]:
        left, size = int(have[k] - take[k]), int(length[k])
        left = min(left, rest // size) if size else 0
        part = 1
        while left > 0 and not reach >> rest & 1:
            part = min(part, left)
            steps.append((int(k), part, reach))
            reach |= (reach << (part * size)) & full
            left -= part
            part *= 2
    at = reach.bit_length() - 1
    for k, part, before in reversed(steps):
        if not before >> at & 1:
            take[k] += part
            at -= part * int(length[k])
    return take


def sized_documents(documents: DataFrame, folder: str = FOLDER, ranks: str = RANKS) -> DataFrame:
    """(doc_id, source, n_tokens) of each document with tokens; equal texts of a batch are encoded once."""

    def size(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, seen = encoder(folder, ranks), {}
        for b in batches:
            if len(seen) > REMEMBERED // 10:
                seen.clear()
            for t in b["text"]:
                if t not in seen:
                    seen[t] = len(bpe.encode_ordinary(t))
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": [seen[t] for t in b["text"]]})

    rows = documents.where(F.length("text") > 0).select("doc_id", label(F.col("source")).alias("source"), "text")
    return rows.mapInPandas(size, "doc_id bigint, source string, n_tokens bigint")


def budgets(sizes: dict[str, int], targets: list[tuple[str, float, int]], total: int | None = None) -> dict[str, tuple[int, int]]:
    """Passes and rest of each source, for ``total`` tokens or the most that every source with documents can support.

    Sources without documents, share or repeats supply nothing; the shares of the others keep their ratio.
    """
    able = {s: (share, repeats) for s, share, repeats in targets if s in sizes and sizes[s] > 0 and share and share > 0 and repeats and repeats > 0}
    weight = sum(share for share, _ in able.values())
    if not able:
        return {}
    most = min(sizes[s] * repeats * weight / share for s, (share, repeats) in able.items())
    wanted = most if total is None else min(most, total)
    out = {}
    for s, (share, repeats) in able.items():
        budget = min(int(wanted * share / weight + 1e-6), sizes[s] * repeats)
        out[s] = (budget // sizes[s], budget % sizes[s])
    return out


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0, folder: str = FOLDER, ranks: str = RANKS) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of each document that is used.

    ``targets`` has one row per source (source, target_share, max_repeats), ``MAX_SOURCES`` at most; a
    source given twice counts once.  Empty or null texts have no tokens and are never used.
    """
    spark = documents.sparkSession
    wanted = targets.where("source is not null").groupBy(label(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = wanted.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sized = cut(sized_documents(documents, folder, ranks).where("n_tokens > 0").join(F.broadcast(wanted.limit(MAX_SOURCES).select("source")), "source", "left_semi"))
    lengths = cut(sized.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("have")))
    sizes = {r[0]: r[1] for r in lengths.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("have"))).collect()}
    plan = budgets(sizes, [tuple(r) for r in rows], total)
    schema = "source string, passes bigint, rest bigint"
    passes = F.broadcast(spark.createDataFrame([(s, p, r) for s, (p, r) in plan.items()], schema))

    def fit(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        take = fit_counts(pdf["n_tokens"].to_numpy("i8"), pdf["have"].to_numpy("i8"), plan[group[0]][1])
        return pdf[["source", "n_tokens"]].assign(take=take)

    fitted = lengths.join(passes.select("source"), "source", "left_semi").groupBy("source").applyInPandas(fit, "source string, n_tokens bigint, take bigint")
    order = F.xxhash64("doc_id", F.lit(seed))
    hashed = sized.withColumns({"order": order, "bucket": F.pmod(order, F.lit(BUCKETS))})
    key = ["source", "n_tokens"]
    counts = hashed.groupBy(*key, "bucket").agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(Window.partitionBy(*key).orderBy("bucket")) - F.col("n")
    room = counts.withColumn("before", so_far).join(fitted, key).select(*key, "bucket", "n", F.greatest(F.lit(0), F.least("n", F.col("take") - F.col("before"))).alias("room"))
    placed = hashed.join(room, [*key, "bucket"])
    # Only the bucket that a length's count ends in is ranked.
    whole = placed.where("room = 0 or room = n").withColumn("more", (F.col("room") > 0).cast("int"))
    rank = F.row_number().over(Window.partitionBy(*key, "bucket").orderBy("order", "doc_id"))
    partly = placed.where("room > 0 and room < n").withColumn("more", (rank <= F.col("room")).cast("int"))
    used = whole.unionByName(partly).join(passes, "source").select("doc_id", "source", "n_tokens", (F.col("passes") + F.col("more")).alias("copies"))
    return used.where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_documents, n_copies, n_tokens, actual_share) of each target source; share null if nothing is used."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"))
    wanted = targets.where("source is not null").groupBy(label(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = wanted.join(got, "source", "left").na.fill(0, ["n_documents", "n_copies", "n_tokens"])
    everything = F.sum("n_tokens").over(Window.partitionBy())  # over one row per source
    return rows.select("source", "target_share", "max_repeats", "n_documents", "n_copies", "n_tokens", (F.col("n_tokens") / F.nullif(everything, F.lit(0))).alias("actual_share"))
