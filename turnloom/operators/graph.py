"""Traversal of typed graphs: adjacency, closures, beams, shortest paths, best-first expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.plans.lineage import cut

# Relations that earn a bonus in an expansion.
STRONG = ["PORTAL", "TEMPORAL_BEFORE", "TEMPORAL_AFTER", "STATE_TRANSITION", "MEMBER_OF"]
#: Neighbours of a node that are scored as one array.
FAN = 512


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, next, relation, edge_id, inverse) of (edge_id, src_id, relation, dst_id)."""
    out = edges.select(F.col("src_id").alias("node"), F.col("dst_id").alias("next"), "relation", "edge_id", F.lit(False).alias("inverse"))
    back = edges.select(F.col("dst_id").alias("node"), F.col("src_id").alias("next"), "relation", "edge_id", F.lit(True).alias("inverse"))
    return out.unionByName(back).dropDuplicates(["node", "next", "edge_id", "inverse"])


def descend(roots: DataFrame, tree: DataFrame, depth: int) -> DataFrame:
    """(root_id, node_id, hops) of everything within ``depth`` of the roots (root_id) along (parent_id, child_id)."""
    level = roots.select("root_id", F.col("root_id").alias("node_id"), F.lit(0).alias("hops"))
    every = level
    for k in range(1, depth + 1):
        level = level.join(tree, level["node_id"] == tree["parent_id"]).select("root_id", F.col("child_id").alias("node_id"), F.lit(k).alias("hops")).distinct()
        every = every.unionByName(level)
    return every.groupBy("root_id", "node_id").agg(F.min("hops").alias("hops"))


def ancestors(leaves: DataFrame, tree: DataFrame, depth: int) -> DataFrame:
    """(leaf_id, node_id, hops) from (leaf_id) up along (parent_id, child_id)."""
    up = tree.select(F.col("child_id").alias("parent_id"), F.col("parent_id").alias("child_id"))
    return descend(leaves.withColumnRenamed("leaf_id", "root_id"), up, depth).withColumnRenamed("root_id", "leaf_id")


def beam_route(queries: DataFrame, nodes: DataFrame, tree: DataFrame, root_beam: int = 2, child_beam: int = 4, depth: int = 8) -> DataFrame:
    """(query_id, node_id, depth, score): nodes admitted from the roots down.

    ``queries`` (query_id, terms), ``nodes`` (node_id, terms, confidence), ``tree`` (parent_id, child_id).  A
    child scores 4 times the share of the query's terms it holds plus 0.01 of its confidence; each parent
    admits its ``child_beam`` best, first those above the confidence alone; ties go to the smaller id.
    """
    def score(df: DataFrame) -> DataFrame:
        share = F.size(F.array_intersect("terms", "query_terms")) / F.greatest(F.lit(1), F.size("query_terms"))
        return df.withColumn("score", F.round(4 * share + 0.01 * F.col("confidence"), 6))

    # What a question admits depends on its terms only: questions of the same terms are routed once.
    asked = queries.select("query_id", F.col("terms").alias("query_terms"))
    kinds = asked.select("query_terms").distinct()
    roots = nodes.join(tree.select(F.col("child_id").alias("node_id")), "node_id", "left_anti")
    # Roots that share a term meet by it; the first ones by id stand in for queries that hit fewer.
    by_term = kinds.select("query_terms", F.explode("query_terms").alias("t")).join(roots.select("node_id", F.explode("terms").alias("t")), "t").select("query_terms", "node_id")
    first = [r[0] for r in roots.orderBy("node_id").select("node_id").limit(root_beam).collect()]
    spare = kinds.select("query_terms", F.explode(F.array(*[F.lit(x) for x in first])).alias("node_id")) if first else by_term.limit(0)
    met = score(by_term.unionByName(spare).distinct().join(roots, "node_id"))
    w = Window.partitionBy("query_terms").orderBy(F.col("score").desc(), "node_id")
    level = cut(met.withColumn("n", F.row_number().over(w)).where(F.col("n") <= root_beam).select("query_terms", "node_id", "score"))
    found = level.withColumn("depth", F.lit(0))
    # Children of like terms and confidence score alike: of each parent's, the ``child_beam`` first by id are all that any question admits.
    alike = Window.partitionBy("parent_id", "terms", "confidence").orderBy("child_id")
    children = tree.join(nodes.withColumnRenamed("node_id", "child_id"), "child_id").select("parent_id", "child_id", "terms", "confidence")
    children = cut(children.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= child_beam).drop("n"))
    for k in range(1, depth + 1):
        down = score(level.select("query_terms", F.col("node_id").alias("parent_id")).join(children, "parent_id"))
        per = Window.partitionBy("query_terms", "parent_id")
        hit = F.col("score") > 0.011
        keep = down.withColumns({"hits": F.count_if(hit).over(per), "n": F.row_number().over(per.orderBy(F.col("score").desc(), "child_id"))})
        keep = keep.where((F.col("n") <= child_beam) & (hit | (F.col("hits") == 0)))
        level = cut(keep.groupBy("query_terms", F.col("child_id").alias("node_id")).agg(F.max("score").alias("score")))
        if level.isEmpty():
            break
        found = found.unionByName(level.withColumn("depth", F.lit(k)))
    found = found.withColumnRenamed("query_terms", "kind")
    return asked.join(found, F.col("query_terms").eqNullSafe(F.col("kind"))).select("query_id", "node_id", "depth", "score")


def shortest_paths(sources: DataFrame, steps: DataFrame, hops: int) -> DataFrame:
    """(source_id, node_id, hops, path): for each node the first path by length, then by its ids, over (node, next)."""
    level = sources.select("source_id", F.col("source_id").alias("node_id"), F.lit(0).alias("hops"), F.array("source_id").alias("path"))
    best = level
    for k in range(1, hops + 1):
        moved = level.join(steps.select("node", "next").distinct(), F.col("node_id") == F.col("node")).select("source_id", F.col("next").alias("node_id"), F.lit(k).alias("hops"), F.concat("path", F.array("next")).alias("path"))
        first = moved.groupBy("source_id", "node_id").agg(F.min(F.struct("hops", "path")).alias("b")).select("source_id", "node_id", "b.*")
        level = cut(first.join(best.select("source_id", "node_id"), ["source_id", "node_id"], "left_anti"))
        if level.isEmpty():
            break
        best = best.unionByName(level)
    return best


def expand(seeds: DataFrame, steps: DataFrame, terms: DataFrame, max_nodes: int, max_hops: int) -> DataFrame:
    """(query_id, node_id, hops, priority, place): what each query visits from its seeds (query_id, node_id, query_terms), level by level.

    A level is one join of the last level's nodes with their ``steps`` (node, next, relation).  A neighbour's
    priority is the share of the query's terms among its own (``terms``: node, terms), 0.25 more over a
    strong relation, 0.08 less a hop; a node met on several ways keeps the best.  Of a level the first of the
    ``max_nodes`` not used yet stay, by priority, then id; nodes of earlier levels are not met again.
    """
    of = Window.partitionBy("query_id")
    level = seeds.groupBy("query_id", "query_terms", "node_id").agg(F.lit(0).alias("hops"), F.lit(1.0).alias("priority"))
    level = level.withColumns({"kind": F.dense_rank().over(of.orderBy("query_terms")), "place": F.row_number().over(of.orderBy("node_id", "query_terms"))})
    level = cut(level.where(F.col("place") <= max_nodes))
    kinds, seen = level.select("query_id", "kind", "query_terms").distinct(), level.drop("query_terms")
    edges = steps.select(F.col("node").alias("node_id"), F.col("next").alias("other"), F.col("relation").isin(STRONG).alias("strong"))
    known = terms.select(F.col("node").alias("other"), "terms", F.row_number().over(Window.partitionBy("node").orderBy("terms")).alias("variant"))
    for hop in range(1, max_hops + 1):
        # Neighbours as arrays of at most about ``FAN``: a query takes the best of each and none is a row of its own before.
        near = edges.join(level.select("node_id").distinct(), "node_id", "left_semi").groupBy("node_id", "other").agg(F.max("strong").alias("strong"))
        near = near.withColumn("part", F.pmod(F.xxhash64("other"), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("node_id")) / FAN)))
        near = near.join(known, "other", "left").groupBy("node_id", "part").agg(F.collect_list(F.struct("other", "variant", "strong", "terms")).alias("others"))
        state = seen.groupBy("query_id").agg(F.collect_set("node_id").alias("met"), F.count(F.lit(1)).alias("used")).where(F.col("used") < max_nodes)
        at = level.select("query_id", "kind", "node_id").distinct().join(kinds, ["query_id", "kind"]).join(state, "query_id").join(near, "node_id")

        def scored(x: Column) -> Column:
            overlap = F.size(F.array_intersect("query_terms", F.coalesce(x["terms"], F.array().cast("array<string>")))) / F.greatest(F.size("query_terms"), F.lit(1))
            priority = F.round(overlap + F.when(x["strong"], 0.25).otherwise(0.0) - 0.08 * hop, 6)
            return F.struct((-priority).alias("less"), x["other"].alias("node_id"), x["variant"].alias("variant"), priority.alias("priority"))

        others = F.transform(F.filter("others", lambda x: ~F.array_contains("met", x["other"])), scored)
        best = at.select("query_id", "kind", "used", F.explode(F.slice(F.array_sort(others), F.lit(1), (max_nodes - F.col("used")).cast("int"))).alias("b"))
        best = best.select("query_id", "kind", "used", "b.node_id", "b.variant", "b.priority").repartition("query_id")
        fresh = best.groupBy("query_id", "kind", "used", "node_id", "variant").agg(F.max("priority").alias("priority"))
        rank = F.row_number().over(of.orderBy(F.col("priority").desc(), "node_id", "kind", "variant"))
        level = fresh.withColumns({"hops": F.lit(hop), "place": (rank + F.col("used")).cast("int")}).where(F.col("place") <= max_nodes)
        level = cut(level.select("query_id", "node_id", "hops", "priority", "kind", "place"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen.select("query_id", "node_id", "hops", "priority", "place")


def components(pairs: DataFrame, rounds: int = 30) -> DataFrame:
    """(node, component): connected components of (a, b) pairs, the least node naming each, by label spreading with pointer jumps."""
    edges = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).withColumnRenamed("a", "node"))
    for _ in range(rounds):
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("other"))
        spread = labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "other").alias("component"), "component")
        spread = spread.toDF("node", "component", "old")
        jump = spread.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = cut(spread.join(jump, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"), "old"))
        labels = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            break
    return labels
