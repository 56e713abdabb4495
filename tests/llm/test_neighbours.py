import numpy as np

from turnloom.llm import neighbours as M

E = "cache_key string, model_id string, dimension int, vector array<float>, cid int"
H = "model_id string, ids array<string>"


def brute(vectors, k, least):
    """{(key, other)} of the k nearest by cosine of float32 unit vectors, ties by key."""
    out = set()
    for a, (ma, va) in vectors.items():
        near = sorted((-float(np.dot(va, vb)), b) for b, (mb, vb) in vectors.items() if b != a and mb == ma)
        out |= {(a, b) for c, b in near[:k] if -c >= least}
    return out


def frames(spark, vectors, extra=()):
    rows = [(k, m, len(v), [float(x) for x in v], 0) for k, (m, v) in vectors.items()] + list(extra)
    listed = [(m, [k for k, (n, _) in vectors.items() if n == m] * 2) for m in {m for m, _ in vectors.values()}]
    return spark.createDataFrame(rows, E), spark.createDataFrame(listed, H)


def made(seed=0, n=600, dims=24):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 20, dims))
    out = {}
    for i in range(n):
        v = centres[i % len(centres)] + 0.35 * rng.standard_normal(dims)
        out[f"k{i:04d}"] = ("a" if i % 3 else "b", (v / np.linalg.norm(v)).astype("f4"))
    return out


def test_recall_against_brute_force(spark):
    vectors = made()
    got = {(r.cache_key, r.other_key) for r in M.nearest_vectors(*frames(spark, vectors), k=10, least=0.5).collect()}
    true = brute(vectors, 10, 0.5)
    assert len(got & true) >= 0.99 * len(true) and len(got & true) >= 0.99 * len(got)


def test_recall_with_ranges_far_smaller_than_the_data(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 64)
    vectors = made(seed=3, n=1500)
    got = {(r.cache_key, r.other_key) for r in M.nearest_vectors(*frames(spark, vectors), k=10, least=0.7).collect()}
    true = brute(vectors, 10, 0.7)
    assert len(got & true) >= 0.9 * len(true)


def tight(n=1800, dims=24):
    """A third of the rows in one group of cosines of about 0.999, their keys dealt at random."""
    rng = np.random.default_rng(5)
    centre, names = rng.standard_normal(dims), rng.permutation(n)
    centre /= np.linalg.norm(centre)
    out = {}
    for i in range(n):
        v = centre + 0.0316 / np.sqrt(dims) * rng.standard_normal(dims) if i % 3 == 0 else rng.standard_normal(dims)
        out[f"k{names[i]:04d}"] = ("a", (v / np.linalg.norm(v)).astype("f4"))
    return out


def test_recall_in_a_tight_group_and_at_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 32)
    vectors = tight()
    true = brute(vectors, 10, 0.8)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("4", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            got = {(r.cache_key, r.other_key) for r in M.nearest_vectors(*frames(spark, vectors), k=10, least=0.8).collect()}
            share = len(got & true) / len(true)
            print(f"recall at {partitions} partitions: {share:.4f}")
            assert share >= 0.97
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_unusable_and_unlisted_vectors_take_no_part(spark):
    v = np.eye(4, dtype="f4")
    vectors = {"a": ("m", v[0]), "b": ("m", v[0] * 3), "c": ("n", v[0])}
    extra = [("z", "m", 4, [0.0] * 4, 1), ("s", "m", 4, [1.0], 1), ("i", "m", 4, [float("inf"), 0.0, 0.0, 0.0], 1), ("n", "m", 4, None, 1), ("u", "m", 4, [1.0, 0.0, 0.0, 0.0], 1), ("x", "m", 4, [1.0, None, 0.0, 0.0], 1)]
    e, h = frames(spark, vectors, extra)
    h = h.unionByName(spark.createDataFrame([("m", ["z", "s", "i", "n", "x", "gone", None]), ("o", ["u"]), ("m", None)], H))
    assert {(r.cache_key, r.other_key) for r in M.nearest_vectors(e, h, least=0.8).collect()} == {("a", "b"), ("b", "a")}


def test_many_copies_list_each_other_and_their_neighbour_finds_them(spark):
    v = np.array([1, 0, 0, 0], "f4")
    vectors = {f"c{i:03d}": ("m", v) for i in range(40)} | {"far": ("m", np.array([0.9, np.sqrt(1 - 0.81), 0, 0], "f4"))}
    got = {}
    for r in M.nearest_vectors(*frames(spark, vectors), k=3, least=0.5).collect():
        got.setdefault(r.cache_key, []).append(r.other_key)
    assert sorted(got["c039"]) == ["c000", "c001", "c002"] and sorted(got["c001"]) == ["c000", "c002", "c003"]
    assert sorted(got["far"]) == ["c000", "c001", "c002"] and len(got) == 41


def test_empty(spark):
    assert M.nearest_vectors(spark.createDataFrame([], E), spark.createDataFrame([], H)).count() == 0
