import os
import random

import numpy as np
import pytest

from turnloom.llm import mixing as X
from turnloom.llm import tokens as K


def test_fitted_counts_meet_reachable_budgets():
    rnd = random.Random(1)
    for _ in range(60):
        n = rnd.randint(1, 6)
        length = np.array(sorted(rnd.sample(range(1, 40), n)))
        have = np.array([rnd.randint(1, 4) for _ in range(n)])
        sums = {0}
        for size, count in zip(length, have):
            sums = {s + k * size for s in sums for k in range(count + 1)}
        budget = rnd.randint(0, int((length * have).sum()) + 5)
        take = X.fit_counts(length, have, budget)
        assert (take >= 0).all() and (take <= have).all() and (length * take).sum() <= budget
        if budget in sums and int((length * have).sum()) > budget and len(length) == 1:
            assert (length * take).sum() == budget


def test_long_histogram_is_met_exactly():
    length, have = np.arange(20, 800), np.full(780, 50)
    for budget in (1_000_003, 77_777, 5_000_001):
        take = X.fit_counts(length, have, budget)
        assert (length * take).sum() == budget and (take <= have).all()


def test_budgets_keep_the_ratio_and_the_caps():
    plan = X.budgets({"a": 100, "b": 1000}, [("a", 0.5, 3), ("b", 0.4, 1), ("gone", 0.1, 9)])
    used = {s: p * {"a": 100, "b": 1000}[s] + r for s, (p, r) in plan.items()}
    assert used["a"] == 300 and used["b"] == 240 and X.budgets({}, [("a", 1.0, 1)]) == {}


@pytest.mark.skipif(not os.path.exists(os.path.join(K.FOLDER, K.RANKS)), reason="no vocabulary files")
def test_mixture(spark):
    docs = [(i, f"word {i} " * (1 + i % 7), "Big " if i % 4 else "small", 1) for i in range(400)] + [(900, None, "big", 1), (901, "", "big", 1), (902, "x", None, 1), (903, "hot", "hot", 1)] + [(1000 + i, "same text here", "hot", 1) for i in range(300)]
    targets = [("big", 0.5, 1), ("SMALL", 0.3, 2), ("hot", 0.1, 1), ("absent", 0.1, 3)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, n_tokens int")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    mixed = X.mix(d, t, seed=4)
    rows = mixed.collect()
    caps = {"big": 1, "small": 2, "hot": 1}
    assert len({r.doc_id for r in rows}) == len(rows) and all(1 <= r.copies <= caps[r.source] for r in rows)
    got = {r.source: r for r in X.shares(mixed, t).collect()}
    whole = sum(r.n_tokens for r in got.values())
    for s, share in (("big", 5 / 9), ("small", 3 / 9), ("hot", 1 / 9)):
        assert abs(got[s].n_tokens - share * whole) <= 10, s
    assert got["absent"].actual_share == 0
    assert {(r.doc_id, r.copies) for r in X.mix(d, t, seed=4).collect()} == {(r.doc_id, r.copies) for r in rows}
    small = X.mix(d, t, total=200, seed=1)
    assert sum(r.copies * r.n_tokens for r in small.collect()) <= 200


@pytest.mark.skipif(not os.path.exists(os.path.join(K.FOLDER, K.RANKS)), reason="no vocabulary files")
def test_empty(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert X.mix(d, t).count() == 0
