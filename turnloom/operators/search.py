"""Lexical and vector search of a batch of questions, each within its scope (a memory).

Texts become postings once (scope, term, id, tf, length); a search is an equi-join on (scope, term), so
hot terms split by id and no side is broadcast.  Scores are rounded to six digits before they are ranked;
ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.text import STOPWORDS, content_terms, terms

K1, B = 1.5, 0.75
#: Query vectors that one pass over the corpus compares.
QUERY_BLOCK = 4096


def top(scored: DataFrame, by: list[str], k: int, score: str = "score", ident: str = "id") -> DataFrame:
    """The ``k`` rows of highest score per ``by``, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), ident)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def postings(docs: DataFrame, scope: str, ident: str, text: str) -> DataFrame:
    """(scope, id, term, tf, length): content terms with their counts; length counts all of a text's content terms."""
    kept = F.filter(terms(F.col(text)), lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS))
    rows = docs.select(F.col(scope).alias("scope"), F.col(ident).alias("id"), kept.alias("words"))
    return rows.select("scope", "id", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("scope", "id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(post: DataFrame) -> DataFrame:
    """(scope, term, df)."""
    return post.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, scope, term, n_terms) of queries (query_id, scope, query)."""
    q = queries.withColumn("words", content_terms(F.col("query")))
    return q.select("query_id", "scope", F.size("words").alias("n_terms"), F.explode("words").alias("term"))


def exact(queries: DataFrame, post: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Share of the query's terms a text holds, half more where it holds all of them, sorted, as one phrase."""
    hits = query_terms(queries).join(post.select("scope", "id", "term"), ["scope", "term"]).groupBy("query_id", "scope", "id", "n_terms").agg(F.count(F.lit(1)).alias("shared"))
    phrase = queries.select("query_id", F.array_join(F.array_sort(content_terms(F.col("query"))), " ").alias("phrase"))
    both = hits.join(texts, "id").join(phrase, "query_id")
    score = F.round(F.col("shared") / F.col("n_terms") + F.when(F.contains(F.lower("text"), F.col("phrase")), 0.5).otherwise(0.0), 6)
    return top(both.select("query_id", "id", score.alias("score")), ["query_id"], k)


def idf(total: Column, df: Column) -> Column:
    return F.log(1 + (total - df + 0.5) / (df + 0.5))


def bm25(queries: DataFrame, post: DataFrame, sizes: DataFrame, k: int, df: DataFrame | None = None) -> DataFrame:
    """BM25 over postings; ``sizes`` is (scope, total, average) with the number of texts and their mean length, ``df`` the stored frequencies if there are any."""
    stats = (document_frequency(post) if df is None else df).join(sizes, "scope").select("scope", "term", "average", idf(F.col("total"), F.col("df")).alias("idf"))
    asked = query_terms(queries).join(stats, ["scope", "term"])
    tf = F.col("tf")
    part = F.col("idf") * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("length") / F.greatest(F.lit(1.0), F.col("average"))))
    scored = asked.join(post, ["scope", "term"]).groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))
    return top(scored.where("score > 0"), ["query_id"], k)


def text_sizes(docs: DataFrame, post: DataFrame, scope: str) -> DataFrame:
    """(scope, total, average) over all texts of a scope, those without terms included."""
    n = docs.groupBy(F.col(scope).alias("scope")).agg(F.count(F.lit(1)).alias("total"))
    sums = post.groupBy("scope").agg(F.sum("tf").alias("words"))
    return n.join(sums, "scope", "left").select("scope", "total", (F.coalesce("words", F.lit(0)) / F.col("total")).alias("average"))


def lexical_hits(queries: DataFrame, post: DataFrame, k: int) -> DataFrame:
    """Distinct query terms a text holds over the query's number of terms."""
    hits = query_terms(queries).join(post.select("scope", "id", "term"), ["scope", "term"])
    return top(hits.groupBy("query_id", "id", "n_terms").agg(F.count(F.lit(1)).alias("n")).select("query_id", "id", F.round(F.col("n") / F.col("n_terms"), 6).alias("score")), ["query_id"], k)


def coverage(queries: DataFrame, post: DataFrame, sizes: DataFrame, df: DataFrame | None = None) -> DataFrame:
    """(query_id, id, coverage): share of the query's idf weight, ln(1 + N / (1 + df)), that a text holds."""
    df = document_frequency(post) if df is None else df
    weight = F.log(1 + F.col("total") / (1 + F.coalesce("df", F.lit(0))))
    asked = query_terms(queries).join(sizes, "scope").join(df, ["scope", "term"], "left").select("query_id", "scope", "term", weight.alias("weight"))
    whole = asked.groupBy("query_id").agg(F.sum("weight").alias("whole"))
    held = asked.join(post.select("scope", "id", "term"), ["scope", "term"]).groupBy("query_id", "id").agg(F.sum("weight").alias("held"))
    return held.join(whole, "query_id").select("query_id", "id", F.round(F.col("held") / F.col("whole"), 6).alias("coverage"))


def dense(queries: DataFrame, vectors: DataFrame, k: int, ident: str = "id", vector: str = "vector", apart: tuple[str, str] | None = None, together: tuple[str, str] | None = None) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` vectors of highest cosine for each query vector, all compared.

    Both sides are cut into blocks: a block of ``QUERY_BLOCK`` queries meets every block of vectors, both by
    shuffle, so neither side is held by the driver or a closure.  Each meeting leaves its own best k per
    query.  With ``apart``, a column of the queries and one of the vectors, pairs with equal values are left
    out before the k are chosen, with ``together`` all others.  Null or zero vectors are never met.
    """
    mine, other = apart or together or (None, None)
    spark = queries.sparkSession
    wide = max(1, -(-queries.count() // QUERY_BLOCK))
    tall = max(int(spark.conf.get("spark.sql.shuffle.partitions")) // wide, 1)
    label = lambda c: (F.lit(None) if c is None else F.col(c)).cast("string").alias("label")
    q = queries.where(F.col(vector).isNotNull()).select(F.pmod(F.xxhash64("query_id"), F.lit(wide)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(tall - 1))).alias("vb"), F.lit(0).alias("side"), F.col("query_id").alias("no"), F.col(vector).cast("array<double>").alias("v"), label(mine))
    v = vectors.where(F.col(vector).isNotNull()).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(wide - 1).cast("bigint"))).alias("qb"), F.pmod(F.xxhash64(ident), F.lit(tall)).cast("int").alias("vb"), F.lit(1).alias("side"), F.col(ident).alias("no"), F.col(vector).cast("array<double>").alias("v"), label(other))

    def unit(rows: pd.DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = rows[rows["v"].map(len) == size]
        m = np.array(rows["v"].tolist(), "f8").reshape(len(rows), size)
        length = np.sqrt((m * m).sum(1))
        good = (length > 0) & np.isfinite(length)
        return rows["no"].to_numpy("i8")[good], m[good] / length[good, None], rows["label"].to_numpy(object)[good]

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, asked = None, []
        for batch in batches:
            for (qb, vb, side), part in batch.groupby(["qb", "vb", "side"], sort=False):
                if (qb, vb) != of:
                    of, asked = (qb, vb), []
                for size in part["v"].map(len).unique():
                    no, m, lab = unit(part, int(size))
                    if side == 0:
                        asked.append((size, no, m, lab))
                        continue
                    for q_size, q_no, q_m, q_lab in asked:
                        if q_size != size or not len(no) or not len(q_no):
                            continue
                        cos = np.round(q_m @ m.T, 6)
                        if mine is not None:
                            cos[(q_lab[:, None] == lab[None, :]) == (apart is not None)] = -2.0
                        order = np.argsort(no, kind="stable")
                        top_k = order[np.argsort(-cos[:, order], axis=1, kind="stable")[:, :k]]
                        score = np.take_along_axis(cos, top_k, 1)
                        keep = score > -1.5
                        yield pd.DataFrame({"query_id": np.repeat(q_no, keep.sum(1)), "id": no[top_k][keep], "score": score[keep]})

    rows = q.unionByName(v).repartition(wide * tall, "qb", "vb").sortWithinPartitions("qb", "vb", "side")
    return top(rows.mapInPandas(meet, "query_id bigint, id bigint, score double"), ["query_id"], k)
