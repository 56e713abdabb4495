from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from turnloom.llm import conversations as C

T = "turn_no bigint, turn_id string, memory_id string, session_id string, turn_index int, speaker string, role string, ts_raw string, raw_text string, ingested_at timestamp, corrected_us string"
S = "memory_id string, session_id string, home_zone string, date_style string"


def frames(spark, sessions):
    """sessions: {id: (has a row, [(index, speaker, role, text)])}."""
    rows, listed, n = [], [], 0
    for sid, (known, turns) in sessions.items():
        if known:
            listed.append(("m", sid, "UTC", "dmy"))
        for index, speaker, role, text in turns:
            n += 1
            rows.append((n, f"t{n}", "m", sid, index, speaker, role, f"2024-01-01 00:{n % 60:02d}:00", text, datetime(2024, 1, 2), "clash"))
    return spark.createDataFrame(rows, T), spark.createDataFrame(listed, S)


def verdicts(spark, sessions):
    turns, listed = frames(spark, sessions)
    placed = C.placed_turns(turns, listed)
    return {r.session_id: sorted(r.reasons) for r in C.judged_sessions(turns, listed, placed).collect()}


U, A = ("user", "user"), ("assistant", "assistant")


def test_each_ground_to_drop(spark):
    got = verdicts(spark, {
        "fine": (True, [(0, *U, "q"), (1, *A, "a")]),
        "no row": (False, [(0, *U, "q"), (1, *A, "a")]),
        "blank": (True, [(0, *U, "​"), (1, *A, "  ")]),
        "gap": (True, [(0, *U, "q"), (2, *A, "a")]),
        "twice": (True, [(0, *U, "q"), (0, *A, "a")]),
        "null index": (True, [(None, *U, "q"), (1, *A, "a")]),
        "no user": (True, [(0, *A, "a")]),
        "open end": (True, [(0, *U, "q"), (1, *A, "a"), (2, *U, "q")]),
        "blank reply": (True, [(0, *U, "q"), (1, *A, "﻿")]),
        "two users": (True, [(0, *U, "q"), (1, *U, "q"), (2, *A, "a")]),
        "tool between": (True, [(0, "s", "system", "x"), (1, *U, "q"), (2, "t", "tool", "x"), (3, *A, "a")]),
        "no turns": (True, []),
    })
    assert got["fine"] == [] and got["tool between"] == []
    assert got["no row"] == ["no_session_row"] and got["no user"] == ["no_user"]
    assert "no_text" in got["blank"] and got["no turns"] == ["no_text", "no_user"]
    assert "broken_index" in got["gap"] and "broken_index" in got["twice"] and "broken_index" in got["null index"]
    for s in ("open end", "blank reply", "two users"):
        assert got[s] == ["unanswered"], s


def test_sides_of_unknown_roles(spark):
    got = verdicts(spark, {
        "by speaker": (True, [(0, "Ann", None, "q"), (1, "Bob", "AI", "a"), (2, "Ann", "Human ", "q"), (3, "Bob", "unknown", "a")]),
        "by name": (True, [(0, "user", None, "q"), (1, "assistant", "", "a")]),
        "nobody knows": (True, [(0, *U, "q"), (1, "Bob", None, "a")]),
    })
    assert got["by speaker"] == [] and got["by name"] == [] and got["nobody knows"] == ["unanswered"]


def test_only_the_latest_delivery_counts(spark):
    turns, listed = frames(spark, {"s": (True, [(0, *U, "q"), (1, *A, " ")])})
    late = turns.where("turn_no = 2").selectExpr("9L AS turn_no", "* EXCEPT (turn_no, raw_text, ingested_at)", "'now' AS raw_text", "timestamp'2024-01-03' AS ingested_at")
    both = turns.unionByName(late)
    assert [r.reasons for r in C.judged_sessions(both, listed, C.placed_turns(both, listed)).collect()] == [[]]
    assert C.conversations(both, listed).count() == 2


def test_long_session_over_blocks(spark):
    n = 2 * C.BLOCK + 2  # the last block of `one over` below holds one turn
    whole = [(i, *(U if i % 2 == 0 else A), "x") for i in range(n)]
    at_border = [t if t[0] != C.BLOCK else (t[0], *U, "x") for t in whole]
    swapped = [(i, *(A if i == C.BLOCK else t[1:3]), t[3]) for i, t in enumerate(at_border)]
    got = verdicts(spark, {"long": (True, whole), "broken at a border": (True, swapped)})
    assert got == {"long": [], "broken at a border": []}
    lone = [(0, "s", "system", "x"), *((i + 1, *t[1:]) for i, t in enumerate(whole[: C.BLOCK]))]
    assert verdicts(spark, {"one over": (True, lone)}) == {"one over": []}
    odd = whole[: C.BLOCK] + [(i, *(U if i == C.BLOCK - 1 else t[1:3]), t[3]) for i, t in list(enumerate(whole))[C.BLOCK :]]
    odd[C.BLOCK - 1] = (C.BLOCK - 1, *U, "x")  # a user turn ends its block, another opens the next
    assert verdicts(spark, {"odd": (True, odd)})["odd"] == ["unanswered"]


def test_clock_offsets_are_least_squares(spark):
    # The assistant's clock is 100 s behind; replies take 10 s, questions follow after 10 s.
    pairs = [{"a": "u", "b": "v", "n": 5, "total": 5 * -90.0, "least": -90.0}, {"a": "v", "b": "u", "n": 4, "total": 4 * 110.0, "least": 110.0}]
    out = next(C._solve(iter([pd.DataFrame({"sid": [b"1"], "pairs": [pairs]})])))
    offset = dict(zip(out["speaker"], out["offset_us"]))
    assert offset["v"] - offset["u"] == 100 and out["clocks_agree"].all()
    bad = [{"a": "u", "b": "v", "n": 1, "total": -90.0, "least": -90.0}, {"a": "v", "b": "u", "n": 1, "total": 10.0, "least": 10.0}]
    assert not next(C._solve(iter([pd.DataFrame({"sid": [b"1"], "pairs": [bad]})])))["clocks_agree"].any()


def test_empty_tables(spark):
    turns, listed = spark.createDataFrame([], T), spark.createDataFrame([], S)
    assert C.judged_sessions(turns, listed, C.placed_turns(turns, listed)).count() == 0
    assert np.isfinite(C.BLOCK)


def test_offsets_of_many_senders_and_in_rounds(spark):
    rnd = np.random.default_rng(3)
    clock = rnd.integers(-500, 500, 400)
    a = rnd.integers(0, 400, 4000)
    b = (a + rnd.integers(1, 400, 4000)) % 400
    x = C._least_squares(a, b, np.ones(4000), 10.0 - clock[b] + clock[a], 400)
    assert np.abs((x - x[0]) - (clock - clock[0])).max() < 1e-3
    few = [(b"1", f"s{i}", f"s{j}", 3, 3.0 * (1_000_000 - 100_000 * j + 100_000 * i), 0.0) for i in range(4) for j in range(4) if i != j]
    df = spark.createDataFrame(few, "sid binary, a string, b string, n bigint, total double, least double")
    got = {r.speaker: r.offset_us for r in C._solve_in_rounds(df).collect()}
    assert all(abs(got[f"s{i}"] - 100_000 * i) < 100 for i in range(4))


def test_pairs_meet_over_block_borders(spark):
    n = C.BLOCK
    rows = [(b"1", i // n, i, i, "a" if i < n else "b", 1000 * i + (50 if i >= n else 0)) for i in range(n - 2, n + 2)]
    got = {r.speaker: r.offset_us for r in C.clock_offsets(spark.createDataFrame(rows, "sid binary, block int, turn_index int, turn_no bigint, speaker string, utc_us bigint")).collect()}
    assert set(got) == {"a", "b"}


def timed(spark, late):
    """A session in which the assistant's clock is ``late`` seconds behind."""
    rows = [(i, f"t{i}", "m", "s", i, *(U if i % 2 == 0 else A), f"2024-01-01 00:00:{20 + i * 2 - (late if i % 2 else 0):02d}", "x", datetime(2024, 1, 2), "") for i in range(8)]
    return spark.createDataFrame(rows, T), spark.createDataFrame([("m", "s", "UTC", "dmy")], S)


def test_offsets_decide_what_is_in_doubt(spark, monkeypatch):
    turns, listed = timed(spark, 15)
    assert [r.doubtful for r in C.merge_verdicts(C.placed_turns(turns, listed)).collect()] == [False]
    none = spark.createDataFrame([], "sid binary, speaker string, offset_us bigint, clocks_agree boolean")
    monkeypatch.setattr(C, "clock_offsets", lambda t: none)
    placed = C.placed_turns(turns, listed)
    assert [r.doubtful for r in C.merge_verdicts(placed).collect()] == [True]
    assert [r.reasons for r in C.judged_sessions(turns, listed, placed).collect()] == [[]]


def test_nothing_is_dropped_without_the_merge(spark, monkeypatch):
    turns, listed = frames(spark, {"gap": (True, [(0, *U, "q"), (2, *A, "a")]), "open": (True, [(0, *U, "q"), (1, *A, "a"), (2, *U, "q")])})
    placed = C.placed_turns(turns, listed)
    assert {len(r.reasons) for r in C.judged_sessions(turns, listed, placed).collect()} == {1}
    verdicts = C.merge_verdicts
    monkeypatch.setattr(C, "merge_verdicts", lambda p: verdicts(p).withColumns({c: F.lit(False) for c in ("no_text", "broken_index", "no_user", "unanswered", "doubtful")}))
    assert {len(r.reasons) for r in C.judged_sessions(turns, listed, placed).collect()} == {0}


def test_crowded_blocks_and_missing_indexes(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 8)
    got = verdicts(spark, {
        "crowded": (True, [(i % 3, *(U if i % 2 == 0 else A), "x") for i in range(40)]),
        "no index": (True, [(None, *(U if i % 2 == 0 else A), "x") for i in range(30)]),
        "whole": (True, [(i, *(U if i % 2 == 0 else A), "x") for i in range(40)]),
        "swapped clocks": (True, [(39 - i, *(A if i % 2 == 0 else U), "x") for i in range(40)]),
    })
    assert "broken_index" in got["crowded"] and "broken_index" in got["no index"] and got["whole"] == got["swapped clocks"] == []


def sessions_of_pairs(rnd, count, senders):
    """{sid: [(a, b, n, total, least)]}, feasible for about half of the sessions."""
    out = {}
    for k in range(count):
        m = int(rnd.integers(2, senders))
        clock = rnd.integers(-10**10, 10**10, m)
        met = {(i, (i + 1) % m) for i in range(m)} | {tuple(p) for p in rnd.integers(0, m, (2 * m, 2)).tolist() if p[0] != p[1]}
        least = {p: int(clock[p[0]] - clock[p[1]] + rnd.integers(-60_000_000 if k % 2 else 0, 90_000_000)) for p in met}
        out[b"%d" % k] = [(f"s{i}", f"s{j}", n, float(n * least[i, j] + rnd.integers(0, 10**8)), float(least[i, j])) for i, j in sorted(met) for n in (int(rnd.integers(1, 9)),)]
    return out


def solved(sessions):
    keys = ("a", "b", "n", "total", "least")
    frame = pd.DataFrame({"sid": list(sessions), "pairs": [[dict(zip(keys, p)) for p in pairs] for pairs in sessions.values()]})
    return {(r.sid, r.speaker): (r.offset_us, r.clocks_agree) for r in next(C._solve(iter([frame]))).itertuples()}


def test_clocks_do_not_depend_on_the_number_of_senders_or_pairs(spark, monkeypatch):
    sessions = sessions_of_pairs(np.random.default_rng(8), 40, 60)
    direct = solved(sessions)
    assert {agree for _, agree in direct.values()} == {True, False}
    monkeypatch.setattr(C, "DIRECT", 0)
    assert solved(sessions) == direct
    monkeypatch.undo()
    rows = [(sid, *p) for sid, pairs in sessions.items() for p in pairs]
    many = C._solve_in_rounds(spark.createDataFrame(rows, "sid binary, a string, b string, n bigint, total double, least double")).collect()
    assert {(bytes(r.sid), r.speaker): (r.offset_us, r.clocks_agree) for r in many} == direct


def test_clocks_of_many_senders_are_judged_exactly():
    # One circle: the least gaps sum up to 0, then to -1; the mean gaps ask for other clocks than the least ones allow.
    n = 3 * C.DIRECT
    a, least = np.arange(n), np.where(np.arange(n) % 2, 70.0, -70.0)
    gap = least + np.where(np.arange(n) < 5, 10_000.0, 1.0)
    x = C._least_squares(a, (a + 1) % n, np.ones(n), gap, n)
    assert not (least + x[(a + 1) % n] - x[a] >= 0).all()
    assert C._feasible(a, (a + 1) % n, least, x)
    least[7] -= 1
    assert not C._feasible(a, (a + 1) % n, least, x)
