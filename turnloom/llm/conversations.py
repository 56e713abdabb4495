"""Operator: ordered conversations from message rows, and the sessions that must be dropped.

The latest delivery of each turn holds.  Every sender's clock offset is the least-squares solution of the
reply-before constraints of the session (a reply's corrected time follows the turn before it by the
session's usual gap), and the senders' turns are merged by corrected time.  A session whose merged order
meets all constraints (the k-th turn has index k, there is a user turn, each is answered by a visible
assistant turn) is feasible and kept as it stands.  Every other session is in doubt: it is checked exactly
in the order of its indexes, and rejected where the constraints are infeasible there too; where only the
clocks are, the indexes are whole and the session is kept.  No broken session can pass the merge: it
accepts an order only where it is that of indexes 0..n-1.

Sessions are never gathered into one task: indexes are cut into blocks of ``BLOCK``, each block is walked on
its own, and only one summary row per block meets the others of its session.  Turns without an index, and
blocks that hold more turns than indexes, are split by hash: such sessions are broken whatever their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.operators.instants import session_clocks, to_instants
from turnloom.plans.lineage import cut

BLOCK = 2048
#: Blocks that the turns of a session without an index go to.
LOOSE = 1024
#: Pairs of senders of a session up to which they come to its task as one row; more come in batches.
PAIRS = 50_000
#: Senders up to which the solution is direct, and how often the other one is begun again at most: both end at the same microseconds.
DIRECT, AGAIN = 256, 20
# Spellings of roles.
USER = ["user", "human", "customer", "client"]
ASSISTANT = ["assistant", "ai", "bot", "model", "agent", "gpt"]
SYSTEM = ["system", "developer"]
TOOL = ["tool", "function"]


def has_visible_text(text: Column) -> Column:
    """Whether a text holds anything but white space, controls, zero-width and blank signs; null is not visible."""
    return F.coalesce(text.rlike(r"[^\s\p{Z}\p{C}⠀ㅤᅟᅠ]"), F.lit(False))


def side_of(name: Column) -> Column:
    """user, assistant, system or tool by spelling, else null."""
    n = F.regexp_replace(F.lower(name), r"[\s\p{Z}\p{C}]+", "")
    return F.when(n.isin(USER), "user").when(n.isin(ASSISTANT), "assistant").when(n.isin(SYSTEM), "system").when(n.isin(TOOL), "tool")


def session_key(memory: str = "memory_id", session: str = "session_id") -> Column:
    """16 bytes that stand for a session; nulls count as a value of their own."""
    return F.unhex(F.md5(F.to_json(F.struct(F.col(memory).alias("m"), F.col(session).alias("s")))))


def latest_turns(turns: DataFrame) -> DataFrame:
    """The latest delivery (ingested_at, then turn_no) of each turn_id; rows without turn_id stand for themselves."""
    body = F.struct("ingested_at", "turn_no", "memory_id", "session_id", "turn_index", "speaker", "role", "ts_raw", has_visible_text(F.col("raw_text")).alias("visible"))
    key = F.coalesce(F.concat(F.lit("t"), F.col("turn_id")), F.concat(F.lit("n"), F.col("turn_no").cast("string")))
    return turns.groupBy(key.alias("key")).agg(F.max(body).alias("b")).select("b.*")


def _least_squares(a: np.ndarray, b: np.ndarray, weight: np.ndarray, gap: np.ndarray, senders: int) -> np.ndarray:
    """Offsets x with x[0] = 0 that bring gap + x[b] - x[a] nearest to one common value, least squares by weight."""
    # Unknowns: the offsets, the first of which gives its place to the common value.
    if senders <= DIRECT:
        rows, k = np.zeros((len(a), senders)), np.arange(len(a))
        for at, sign in ((b, 1.0), (a, -1.0)):
            rows[k[at > 0], at[at > 0]] += (sign * weight)[at > 0]
        rows[:, 0] = -weight
        x = np.linalg.lstsq(rows, -weight * gap, rcond=None)[0]
    else:  # conjugate gradients, two passes over the pairs a step, begun again on what is left until nothing moves by a hundredth
        def times(x: np.ndarray) -> np.ndarray:
            y = np.concatenate([[0.0], x[1:]])
            return weight * (y[b] - y[a] - x[0])

        def back(r: np.ndarray) -> np.ndarray:
            out = np.bincount(b, weight * r, senders) - np.bincount(a, weight * r, senders)
            out[0] = -(weight * r).sum()
            return out

        x = np.zeros(senders)
        for _ in range(AGAIN):
            r, move = -weight * gap - times(x), np.zeros(senders)
            d = g = back(r)
            size = float(g @ g)
            # Sums of terms of this size have no more digits.
            rough = np.bincount(b, weight * np.abs(r), senders) + np.bincount(a, weight * np.abs(r), senders)
            rough[0] = (weight * np.abs(r)).sum()
            enough = max(1e-18 * size, 1e-30 * float(rough @ rough))
            for _ in range(2 * senders):
                if size <= enough or not size:
                    break
                q = times(d)
                step = size / float(q @ q)
                move, r = move + step * d, r - step * q
                g = back(r)
                size, last = float(g @ g), size
                d = g + size / last * d
            x = x + move
            if np.abs(move).max() < 0.01:
                break
    x[0] = 0.0
    return x


def _feasible(a: np.ndarray, b: np.ndarray, least: np.ndarray, x: np.ndarray) -> bool:
    """Whether some clocks bring every reply after the turn before it: no cycle of least gaps is negative.

    Begun at the clocks ``x`` in whole microseconds, so all sums are exact. What each sender's bound last came
    from is looked at in rounds 1, 2, 4 and so on: bounds that come from each other in a circle are a negative cycle.
    """
    far, source = -np.rint(x), np.full(len(x) + 1, len(x))
    for k in range(len(x) + 1):
        nearer = far.copy()
        np.minimum.at(nearer, b, far[a] + least)
        moved = nearer < far
        if not moved.any():
            return True
        by = moved[b] & (far[a] + least == nearer[b])
        source[b[by]] = a[by]
        far = nearer
        if k & (k - 1) == 0:
            at = source
            for _ in range(len(x).bit_length()):
                at = at[at]
            if (at < len(x)).any():
                return False
    return False


def _offsets(a: list[str], b: list[str], n: np.ndarray, total: np.ndarray, least: np.ndarray) -> tuple[list[str], np.ndarray, bool]:
    """Senders of a session, their offsets and whether clocks are feasible, whatever the order of its pairs."""
    senders = sorted({*a, *b})
    at = {s: i for i, s in enumerate(senders)}
    a, b = (np.array([at[s] for s in c]) for c in (a, b))
    order = np.lexsort((b, a))
    a, b, n, total, least = a[order], b[order], n[order], total[order], least[order]
    x = _least_squares(a, b, np.sqrt(n), total / n, len(senders))
    return senders, np.rint(x).astype("i8"), _feasible(a, b, least, x)


def _solve(stats: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Least-squares clock offsets of each session from (sender, next sender, count, sum, least gap)."""
    for batch in stats:
        out = []
        for sid, pairs in zip(batch["sid"], batch["pairs"]):
            n, total, least = (np.array([p[c] for p in pairs], "f8") for c in ("n", "total", "least"))
            senders, x, feasible = _offsets([p["a"] for p in pairs], [p["b"] for p in pairs], n, total, least)
            out += [(sid, s, int(o), feasible) for s, o in zip(senders, x)]
        yield pd.DataFrame(out, columns=["sid", "speaker", "offset_us", "clocks_agree"])


def _solve_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """As ``_solve`` from rows sorted by session."""
    def solved(sid: bytes, parts: list[pd.DataFrame]) -> pd.DataFrame:
        p = pd.concat(parts)
        senders, x, feasible = _offsets(p["a"].tolist(), p["b"].tolist(), *(p[c].to_numpy("f8") for c in ("n", "total", "least")))
        return pd.DataFrame({"sid": [sid] * len(senders), "speaker": senders, "offset_us": x, "clocks_agree": feasible})

    held, parts = None, []
    for batch in batches:
        for sid, part in batch.groupby("sid", sort=False):
            if parts and sid != held:
                yield solved(held, parts)
                parts = []
            held = sid
            parts.append(part)
    if parts:
        yield solved(held, parts)


def _solve_in_rounds(stats: DataFrame) -> DataFrame:
    """As ``_solve``, with the same results, for sessions of very many pairs: these come to their task in batches instead of as one row."""
    return stats.repartition("sid").sortWithinPartitions("sid").mapInPandas(_solve_sorted, "sid binary, speaker string, offset_us bigint, clocks_agree boolean")


def clock_offsets(turns: DataFrame) -> DataFrame:
    """(sid, speaker, offset_us, clocks_agree) from turns with sid, block, turn_index, turn_no, speaker, utc_us.

    Pairs are neighbours by turn_index, of different senders, both with a time; the last of a block meets
    the first of the next.  Sessions with one sender keep their clocks.
    """
    w = Window.partitionBy("sid", "block").orderBy("turn_index", "turn_no")
    timed = turns.where("turn_index is not null and speaker is not null and utc_us is not null")
    inner = timed.select("sid", F.col("speaker").alias("a"), F.lead("speaker").over(w).alias("b"), (F.lead("utc_us").over(w) - F.col("utc_us")).alias("gap"))
    said, at = F.struct("speaker", "utc_us"), F.struct("turn_index", "turn_no")
    edges = timed.groupBy("sid", "block").agg(F.min_by(said, at).alias("first"), F.max_by(said, at).alias("last"))
    of = Window.partitionBy("sid").orderBy("block")
    border = edges.select("sid", F.col("last.speaker").alias("a"), F.lead("first.speaker").over(of).alias("b"), (F.lead("first.utc_us").over(of) - F.col("last.utc_us")).alias("gap"))
    pairs = inner.unionByName(border).where("a <> b")
    stats = cut(pairs.groupBy("sid", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("gap").cast("double")).alias("total"), F.min(F.col("gap").cast("double")).alias("least")))
    large = cut(stats.groupBy("sid").count().where(F.col("count") > PAIRS).select("sid"))
    if large.isEmpty():
        rest, rounds = stats, None
    else:
        rest, rounds = stats.join(large, "sid", "left_anti"), _solve_in_rounds(stats.join(large, "sid", "left_semi"))
    per = rest.groupBy("sid").agg(F.collect_list(F.struct("a", "b", "n", "total", "least")).alias("pairs"))
    got = per.mapInPandas(_solve, "sid binary, speaker string, offset_us bigint, clocks_agree boolean")
    return got if rounds is None else got.unionByName(rounds)


def _spread(timed: DataFrame) -> DataFrame:
    """Turns with ``crowded``: whether their block holds more turns than indexes. Such blocks are split by hash into ones of about ``BLOCK``."""
    full = cut(timed.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > BLOCK))
    if full.isEmpty():
        return timed.withColumns({"crowded": F.lit(False), "part": F.lit(0)})
    part = F.pmod(F.xxhash64("turn_no"), F.ceil(F.col("held") / BLOCK)).cast("int")
    return timed.join(F.broadcast(full) if full.count() <= 10_000 else full, ["sid", "block"], "left").withColumns({"crowded": F.col("held").isNotNull(), "part": F.coalesce(part, F.lit(0))}).drop("held")


def placed_turns(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Latest turns with their side, clock offset and corrected time.

    The side is the role's; where that is null or unknown, the most frequent side of the same speaker in
    the session (ties: user before assistant), else the one the speaker's name spells, else ``unknown``.
    """
    late = latest_turns(turns).join(session_clocks(sessions), ["memory_id", "session_id"], "left")
    block = F.coalesce(F.floor(F.col("turn_index") / BLOCK), -1 - F.pmod(F.xxhash64("turn_no"), F.lit(LOOSE))).cast("int")
    keyed = late.withColumns({"sid": session_key(), "block": block, "said": side_of(F.col("role"))})
    timed = cut(to_instants(keyed, ["sid", "block", "turn_no", "turn_index", "speaker", "said", "visible"]))
    counts = [F.sum((F.col("said") == s).cast("int")).alias(s) for s in ("user", "assistant", "system", "tool")]
    most = F.greatest("user", "assistant", "system", "tool")
    spoken = (
        timed.where("said is not null and speaker is not null").groupBy("sid", "speaker").agg(*counts)
        .select("sid", "speaker", F.when(F.col("user") == most, "user").when(F.col("assistant") == most, "assistant").when(F.col("system") == most, "system").otherwise("tool").alias("usual"))
    )
    senders = spoken.join(clock_offsets(timed), ["sid", "speaker"], "full")
    return _spread(timed).join(senders, ["sid", "speaker"], "left").select(
        "sid", "block", "part", "crowded", "turn_no", "turn_index", "speaker", "visible", "utc_us",
        F.coalesce("said", "usual", side_of(F.col("speaker")), F.lit("unknown")).alias("side"),
        F.coalesce("offset_us", F.lit(0)).alias("offset_us"),
        (F.col("utc_us") + F.coalesce("offset_us", F.lit(0))).alias("corrected_us"),
        F.coalesce("clocks_agree", F.lit(True)).alias("clocks_agree"),
    )


def merged(placed: DataFrame) -> DataFrame:
    """Turns with ``merge_us``, the time by which they are merged: the corrected one, or that of the turn before (else after) by index in the block."""
    w = Window.partitionBy("sid", "block", "part").orderBy(F.col("turn_index").asc_nulls_last(), "turn_no")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return placed.withColumn("merge_us", F.coalesce(F.last("corrected_us", True).over(before), F.first("corrected_us", True).over(after)))


def session_verdicts(placed: DataFrame, by_time: bool = False) -> DataFrame:
    """Per sid: n_turns, clocks_agree and the flags no_text, broken_index, no_user, unanswered.

    In the order of the indexes, or ``by_time`` in that of ``merge_us``: then a turn whose index is not its
    place, or a block that begins before the one before it ends, counts as a broken index.
    """
    if by_time:
        order = [F.col("merge_us").asc_nulls_first(), F.col("turn_index").asc_nulls_last(), F.col("turn_no")]
    else:
        order = [F.col("turn_index").asc_nulls_last(), F.col("corrected_us").asc_nulls_last(), F.col("turn_no")]
    w = Window.partitionBy("sid", "block", "part").orderBy(*order)
    talk = ~F.col("side").isin("system", "tool")
    answers = (F.col("side") == "assistant") & F.col("visible")
    # The next talking turn after each row of the block, system and tool turns passed over.
    after = w.rowsBetween(1, Window.unboundedFollowing)
    rows = placed.select(
        "*",
        F.lead("turn_index").over(w).alias("next_index"),
        F.first(F.when(talk, answers), ignorenulls=True).over(after).alias("then_answered"),
        F.row_number().over(w).alias("rank"),
    )
    misplaced = F.col("turn_index") != F.col("block") * BLOCK + F.col("rank") - 1 if by_time else F.col("next_index") == F.col("turn_index")
    blocks = rows.groupBy("sid", "block", "part").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("turn_index").alias("low"),
        F.max("turn_index").alias("high"),
        F.max(F.col("crowded") | F.col("turn_index").isNull() | (F.col("turn_index") < 0) | F.coalesce(misplaced, F.lit(False))).alias("clash"),
        *([F.min("merge_us").alias("from_us"), F.max("merge_us").alias("to_us")] if by_time else []),
        F.max("visible").alias("text"),
        F.max(F.col("side") == "user").alias("user"),
        F.max((F.col("side") == "user") & F.coalesce(~F.col("then_answered"), F.lit(False))).alias("unanswered"),
        F.min_by(answers, F.when(talk, F.col("rank"))).alias("opens_answered"),
        F.max(talk).alias("talks"),
        F.max((F.col("side") == "user") & F.col("then_answered").isNull()).alias("ends_with_user"),
        F.min("clocks_agree").alias("clocks_agree"),
    )
    of = Window.partitionBy("sid").orderBy("block", "part")
    if by_time:
        earlier = F.max("to_us").over(of.rowsBetween(Window.unboundedPreceding, -1))
        blocks = blocks.withColumn("clash", F.col("clash") | F.coalesce(earlier > F.col("from_us"), F.lit(False)))
    blocks = blocks.withColumn("next_opens", F.first(F.when(F.col("talks"), F.col("opens_answered")), ignorenulls=True).over(of.rowsBetween(1, Window.unboundedFollowing)))
    return blocks.groupBy("sid").agg(
        F.sum("n").alias("n_turns"),
        F.min("clocks_agree").alias("clocks_agree"),
        (~F.max("text")).alias("no_text"),
        (F.max(F.coalesce("clash", F.lit(True))) | F.coalesce(F.min("low") != 0, F.lit(True)) | F.coalesce(F.max("high") != F.sum("n") - 1, F.lit(True))).alias("broken_index"),
        (~F.max("user")).alias("no_user"),
        F.max(F.col("unanswered") | (F.col("ends_with_user") & ~F.coalesce("next_opens", F.lit(False)))).alias("unanswered"),
    )


def merge_verdicts(placed: DataFrame) -> DataFrame:
    """The verdicts by merged time, with ``doubtful``: whether the merged order breaks a constraint."""
    return session_verdicts(merged(placed), by_time=True).withColumn("doubtful", F.col("no_text") | F.col("broken_index") | F.col("no_user") | F.col("unanswered"))


def judged_sessions(turns: DataFrame, sessions: DataFrame, placed: DataFrame) -> DataFrame:
    """Every session of either table with n_turns, clocks_agree and ``reasons``, the array of grounds to drop it.

    Grounds: no_session_row, no_text (also for a session without turns), broken_index, no_user, unanswered.
    An empty array means the session is kept.  Sessions that the merge finds feasible are kept without
    further check; all others are checked in the order of their indexes.
    """
    first = cut(merge_verdicts(placed))
    doubtful = placed.join(first.where("doubtful").select("sid"), "sid", "left_semi")
    verdicts = session_verdicts(doubtful).unionByName(first.where("not doubtful").drop("doubtful"))
    listed = sessions.select("memory_id", "session_id").distinct().withColumn("listed", F.lit(True))
    met = turns.select("memory_id", "session_id").distinct()
    both = listed.withColumn("sid", session_key()).join(met.select(session_key().alias("sid"), F.col("memory_id").alias("m2"), F.col("session_id").alias("s2")), "sid", "full")
    both = both.select("sid", F.coalesce("memory_id", "m2").alias("memory_id"), F.coalesce("session_id", "s2").alias("session_id"), F.coalesce("listed", F.lit(False)).alias("listed"))
    v = both.join(verdicts, "sid", "left")
    flag = lambda cond, name: F.when(cond, F.lit(name))
    reasons = F.array_compact(F.array(
        flag(~F.col("listed"), "no_session_row"),
        flag(F.coalesce("no_text", F.lit(True)), "no_text"),
        flag(F.coalesce("broken_index", F.lit(False)), "broken_index"),
        flag(F.coalesce("no_user", F.lit(True)), "no_user"),
        flag(F.coalesce("unanswered", F.lit(False)), "unanswered"),
    ))
    return v.select("sid", "memory_id", "session_id", F.coalesce("n_turns", F.lit(0)).alias("n_turns"), F.coalesce("clocks_agree", F.lit(True)).alias("clocks_agree"), reasons.alias("reasons"))


def conversations(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Turns of the kept sessions in order: memory_id, session_id, position, side, speaker, raw_text and corrected time."""
    placed = cut(placed_turns(turns, sessions))
    kept = judged_sessions(turns, sessions, placed).where(F.size("reasons") == 0).select("sid", "memory_id", "session_id", "clocks_agree")
    text = turns.select("turn_no", "turn_id", "raw_text")
    return (
        placed.drop("clocks_agree").join(kept, "sid").join(text, "turn_no")
        .select("memory_id", "session_id", F.col("turn_index").alias("position"), "turn_id", "turn_no", "speaker", "side", "raw_text", "corrected_us", "offset_us", "clocks_agree")
    )
