"""Operator: the most similar vectors of every vector, by a forest of hash prefixes.

Each tree gives a vector a key: the signs of its products with random directions, then the bits of some
further products from the highest to the lowest, which tell apart what the signs leave equal.  A tree is
the sorted array of all keys of a model, cut into blocks.  A vector descends to its own block in every
tree, where its longest common prefixes stand, and ascends in all trees together: the next block it meets
is always the one with the longest prefix in common, on either side and in whichever tree, until enough
entries are met.  Of all met the nearest are kept with their exact cosines.  Exact copies count as one
vector in the forest and are listed afterwards, so no copy is lost and none fills a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.plans.lineage import cut, width

TREES, BITS = 16, 63
#: Further products of a tree, and the bits of each.
FINE, STEPS = 8, 24
#: Entries of a block, at most.
BLOCK = 512
#: Blocks' worth of entries that a vector meets for each tree before its ascent ends.
ENOUGH = 2
#: Vectors whose products are held at once.
ROWS = 256


def usable_vectors(embeddings: DataFrame, handles: DataFrame) -> DataFrame:
    """(model_id, cache_key, vec) of the usable vectors that a handle of their model lists; vec holds float32 of unit length.

    Unusable: null, not ``dimension`` long, zero, or with a null or non-finite entry.  Ids listed twice count once.
    """
    listed = handles.select("model_id", F.explode("ids").alias("cache_key")).where("cache_key is not null and model_id is not null").distinct()
    rows = embeddings.where(F.size("vector") == F.col("dimension")).select("model_id", "cache_key", "vector").join(listed, ["model_id", "cache_key"], "left_semi")

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for vector in b["vector"]:
                v = np.array(vector, "f8")
                size = np.sqrt((v * v).sum()) if np.isfinite(v).all() else 0.0
                out.append((v / size).astype("f4").tobytes() if size > 0 and np.isfinite(size) else None)
            yield b[["model_id", "cache_key"]].assign(vec=out)

    return rows.mapInPandas(unit, "model_id string, cache_key string, vec binary").where("vec is not null")


def _directions(model_id: str, dimension: int, trees: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    seed = int.from_bytes(hashlib.sha256(f"{model_id}/{dimension}".encode()).digest()[:8], "little")
    rng = np.random.default_rng(seed)
    signs = rng.standard_normal((dimension, trees * BITS), dtype="f4")
    fine = rng.standard_normal((dimension, trees * FINE), dtype="f4")
    return signs, fine / np.sqrt((fine * fine).sum(0)), rng.random(trees * FINE)


def _keys(v: np.ndarray, directions: tuple[np.ndarray, np.ndarray, np.ndarray], trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Per vector and tree the signs as a number, and the whole key as bytes."""
    signs, fine, shift = directions
    codes = ((v @ signs) > 0).reshape(len(v), trees, BITS) @ (1 << np.arange(BITS - 1, -1, -1, dtype="i8"))
    steps = ((v @ fine + 1.0 + shift) * (1 << (STEPS - 2))).astype(">u4").reshape(len(v), trees, FINE, 1)
    bits = np.unpackbits(steps.view("u1"), axis=-1)[..., 32 - STEPS :]
    tail = np.packbits(bits.swapaxes(2, 3).reshape(len(v), trees, -1), axis=-1)
    return codes, np.ascontiguousarray(np.concatenate([codes.astype(">i8")[..., None].view("u1"), tail], axis=-1))


def _parts(batches: Iterator[pd.DataFrame], trees: int) -> Iterator[tuple]:
    """(model, size, rows, codes, keys) of at most 1,024 vectors of one model and size."""
    known: dict[tuple[str, int], tuple] = {}
    for b in batches:
        for (model, size), part in b.groupby([b["model_id"], b["vec"].map(len)]):
            if (model, size) not in known:
                known[model, size] = _directions(model, size // 4, trees)
            for start in range(0, len(part), 1024):
                some = part.iloc[start : start + 1024]
                v = np.frombuffer(b"".join(some["vec"]), "f4").reshape(len(some), -1)
                yield model, size, some, *_keys(v, known[model, size], trees)


def forest(vectors: DataFrame, trees: int = TREES) -> DataFrame:
    """(model_id, size, tree, key): an entry for each vector in every tree."""

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for model, size, some, _, keys in _parts(batches, trees):
            yield pd.DataFrame({"model_id": model, "size": size, "tree": np.tile(np.arange(trees, dtype="i4"), len(some)), "key": [k.tobytes() for k in keys.reshape(-1, keys.shape[-1])]})

    return vectors.select("model_id", "vec").mapInPandas(grow, "model_id string, size int, tree int, key binary")


def blocks(entries: DataFrame, n: int) -> dict[tuple[str, int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each sorted array the first key of every block, the sign numbers of its first and last, and its entries: a row for up to ``BLOCK`` entries.

    ``n`` is the number of ranges that are sorted; a block that ends with its range is only shorter.
    """
    block = BLOCK

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, first, last, count = None, b"", b"", 0
        for b in batches:
            for at, part in b.groupby(["model_id", "size", "tree"], sort=False):
                keys, start = part["key"].to_numpy(object), 0
                while start < len(keys):
                    if at != of or count == block:
                        if count:
                            yield pd.DataFrame([(*of, first, last, count)], columns=names)
                        of, first, count = at, keys[start], 0
                    take = min(block - count, len(keys) - start)
                    start, count = start + take, count + take
                    last = keys[start - 1]
        if count:
            yield pd.DataFrame([(*of, first, last, count)], columns=names)

    names = ["model_id", "size", "tree", "first", "last", "entries"]
    ordered = entries.repartitionByRange(n, "model_id", "size", "tree", "key").sortWithinPartitions("model_id", "size", "tree", "key")
    rows = ordered.mapInPandas(split, "model_id string, size int, tree int, first binary, last binary, entries int").toPandas()
    out = {}
    for at, part in rows.groupby(["model_id", "size", "tree"]):
        part = part.sort_values("first")
        first, last = (np.array([np.frombuffer(k[:8], ">i8")[0] for k in part[c]], "i8") for c in ("first", "last"))
        out[at] = np.array([bytes(k) for k in part["first"]], f"S{8 + FINE * STEPS // 8}"), np.stack([first, last]), part["entries"].to_numpy("i8")
    return out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of two sign numbers."""
    return BITS - np.frexp((a ^ b).astype("f8"))[1]


def _ascend(codes: np.ndarray, home: np.ndarray, trees: list[tuple[np.ndarray, np.ndarray]], enough: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last block that each vector meets in each tree, where ``trees`` has the sign numbers of the blocks' edges and their entries."""
    low, high = home.copy(), home.copy()
    met = np.sum([size[home[:, t]] for t, (_, size) in enumerate(trees)], axis=0)
    # Prefix in common with the next block below and above; -1e9 where the array ends.
    score = np.empty((len(codes), len(trees), 2))

    def look(rows: np.ndarray, t: int) -> None:
        (first, last), far = trees[t][0], len(trees[t][1]) - 1
        for side, at in enumerate((low[rows, t] - 1, high[rows, t] + 1)):
            inside = (at >= 0) & (at <= far)
            edge = (last, first)[side][np.clip(at, 0, far)]
            # Of equal prefixes the nearer block.
            score[rows, t, side] = np.where(inside, _common(codes[rows, t], edge) - np.abs(at - home[rows, t]) / 1e6, -1e9)

    for t in range(len(trees)):
        look(np.arange(len(codes)), t)
    while True:
        best = score.reshape(len(codes), -1).argmax(1)
        rows = np.flatnonzero((met < enough) & (score.reshape(len(codes), -1)[np.arange(len(codes)), best] > -1e8))
        if not len(rows):
            return low, high
        for t in range(len(trees)):
            mine = rows[best[rows] // 2 == t]
            up = best[mine] % 2 == 1
            high[mine[up], t] += 1
            low[mine[~up], t] -= 1
            met[mine] += trees[t][1][np.where(up, high[mine, t], low[mine, t])]
            look(mine, t)


def visits(vectors: DataFrame, known: dict[tuple[str, int, int], tuple], trees: int = TREES) -> DataFrame:
    """(model_id, size, tree, block, guest, cid, vec): each vector in its own block of every tree, and as a guest in those its ascent meets."""
    enough = ENOUGH * trees * BLOCK

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for model, size, some, codes, keys in _parts(batches, trees):
            arrays = [known[model, size, t] for t in range(trees)]
            flat = keys.view(f"S{keys.shape[-1]}")[..., 0]
            home = np.stack([np.maximum(0, np.searchsorted(first, flat[:, t], "right") - 1) for t, (first, _, _) in enumerate(arrays)], axis=1)
            low, high = _ascend(codes, home, [(edges, entries) for _, edges, entries in arrays], enough)
            count = (high - low + 1).ravel()
            row, tree = np.divmod(np.repeat(np.arange(count.size), count), trees)
            block = np.repeat(low.ravel(), count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            yield pd.DataFrame({
                "model_id": model, "size": size, "tree": tree.astype("i4"), "block": block.astype("i4"), "guest": block != home[row, tree],
                "cid": some["cid"].to_numpy()[row], "vec": some["vec"].to_numpy(object)[row],
            })

    return vectors.select("model_id", "cid", "vec").mapInPandas(go, "model_id string, size int, tree int, block int, guest boolean, cid bigint, vec binary")


def _nearest(a: np.ndarray, va: np.ndarray, b: np.ndarray, vb: np.ndarray, k: int, least: float) -> Iterator[pd.DataFrame]:
    """Pairs of a and b that are among the k nearest of one side, with a cosine of ``least`` or more."""
    for start in range(0, len(a), ROWS):
        cos = va[start : start + ROWS] @ vb.T
        r, c = np.nonzero(cos >= least)
        v = cos[r, c]
        one, two = a[start + r], b[c]
        keep = one != two
        r, c, v, one, two = r[keep], c[keep], v[keep], one[keep], two[keep]
        good = np.zeros(len(r), bool)
        for side in (r, c):
            order = np.lexsort((-v, side))
            first = np.flatnonzero(np.diff(side[order], prepend=-1))
            rank = np.arange(len(order)) - np.repeat(first, np.diff([*first, len(order)]))
            good[order[rank < k]] = True
        yield pd.DataFrame({"a": np.minimum(one, two)[good], "b": np.maximum(one, two)[good], "cosine": v[good].astype("f8")})


def candidate_pairs(visited: DataFrame, n: int, k: int, least: float) -> DataFrame:
    """(a, b, cosine) with a < b: near pairs of all trees, each once; the entries of a block meet each other and its guests. ``n`` is the number of tasks."""
    block = ["model_id", "size", "tree", "block"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, ids, held = None, np.zeros(0, "i8"), np.zeros((0, 0), "f4")
        for b in batches:
            for (*at, guest), part in b.groupby([*block, "guest"], sort=False):
                v, new = np.frombuffer(b"".join(part["vec"]), "f4").reshape(len(part), -1), part["cid"].to_numpy()
                if at != of:
                    of, ids, held = at, new[:0], v[:0]
                if not guest:
                    ids, held = np.concatenate([ids, new]), np.concatenate([held, v])
                if len(ids):
                    yield from _nearest(new, v, ids, held, k, least)

    ordered = visited.repartition(n, *block).sortWithinPartitions(*block, "guest")
    return ordered.mapInPandas(walk, "a bigint, b bigint, cosine double").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def nearest_vectors(embeddings: DataFrame, handles: DataFrame, k: int = 10, least: float = -1.0, trees: int = TREES) -> DataFrame:
    """(model_id, cache_key, other_key, cosine): of each usable listed vector its k most similar others of the model, of cosine ``least`` or more.

    Ties go to the smaller key.  Cosines are exact; which vectors are met is the forest's (recall is
    measured in the tests).  Copies are each other's nearest.
    """
    usable = cut(usable_vectors(embeddings, handles).withColumn("h", F.unhex(F.md5("vec"))))
    classes = usable.groupBy("model_id", "h").agg(F.min_by("vec", "cache_key").alias("vec"), F.count(F.lit(1)).alias("members"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))
    entries = classes.count() * trees
    known = blocks(forest(classes, trees), -(-entries // 200_000) or 1)
    pairs = candidate_pairs(visits(classes, known, trees), width(embeddings.sparkSession, ENOUGH * entries, 40_000), k, least)
    both = pairs.select(F.col("a").alias("cid"), F.col("b").alias("other"), "cosine").unionByName(pairs.select(F.col("b").alias("cid"), F.col("a").alias("other"), "cosine"))
    w = Window.partitionBy("cid").orderBy(F.col("cosine").desc(), "other")
    near = both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    members = usable.select("model_id", "h", "cache_key").join(classes.select("model_id", "h", "cid", "members"), ["model_id", "h"])
    # The first k + 1 keys of a class stand for all its members in any list.
    heads = (
        members.where("members > 1").withColumn("place", F.row_number().over(Window.partitionBy("cid").orderBy("cache_key"))).where(F.col("place") <= k + 1).select("cid", "cache_key", "place")
        .unionByName(members.where("members = 1").select("cid", "cache_key", F.lit(1).alias("place")))
    )
    own = heads.join(classes.where("members > 1").select("cid"), "cid", "left_semi").select("cid", "cache_key", F.lit(1.0).alias("cosine"), F.lit(0).alias("rank"), "place")
    others = near.join(heads.withColumnRenamed("cid", "other"), "other").select("cid", "cache_key", "cosine", "rank", "place")
    order = Window.partitionBy("cid").orderBy("rank", F.col("cosine").desc(), "cache_key")
    lists = own.unionByName(others).withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k + 1)
    lists = lists.select("cid", F.col("cache_key").alias("other_key"), "cosine", "pos")
    mine = heads.join(classes.where("members > 1").select("cid"), "cid", "left_semi").select("cid", "cache_key", F.lit(1).alias("itself"))
    asked = members.select("model_id", "cid", "cache_key").join(mine, ["cid", "cache_key"], "left")
    got = asked.join(lists, "cid").where((F.col("cache_key") != F.col("other_key")) & (F.col("pos") <= k + F.coalesce("itself", F.lit(0))))
    return got.select("model_id", "cache_key", "other_key", "cosine")
