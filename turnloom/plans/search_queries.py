"""Queries of search and fusion over turns, questions and embeddings, and their SQL twins.

Questions whose number is divisible by 20 are the query set; each searches all turns of its memory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions import vectors as V
from turnloom.functions.text import content_terms
from turnloom.operators import fusion as U
from turnloom.operators import search as S
from turnloom.plans.lineage import cut
from turnloom.plans.text_queries import _SLOTS, sql_content
from turnloom.sources.index import LexicalIndex
from turnloom.sources.tables import table

K = 10


def asked(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "questions", "question_id", "memory_id", "question")
    return q.where(F.pmod(F.split("question_id", "_")[2].cast("int"), F.lit(20)) == 0).select(F.col("question_id").alias("query_id"), F.col("memory_id").alias("scope"), F.col("question").alias("query"))


def _turns(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns, their stored postings and the memories' sizes."""
    index = LexicalIndex(spark, folder, "turns")
    return table(spark, folder, "turns", "turn_no", "memory_id", "session_id", "raw_text"), index.read("postings"), index.read("sizes")


def _frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return LexicalIndex(spark, folder, "turns").read("df")


def agg_df(spark: SparkSession, folder: str) -> DataFrame:
    """Document frequency of each term by turn and by session."""
    t = table(spark, folder, "turns", "turn_no", "memory_id", "session_id", "raw_text")
    w = t.select("turn_no", "memory_id", "session_id", F.explode(content_terms(F.col("raw_text"))).alias("term"))
    per = w.groupBy("memory_id", "session_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("memory_id", "term").agg(F.sum("n").alias("turns"), F.count(F.lit(1)).alias("sessions"))


def agg_postings(spark: SparkSession, folder: str) -> DataFrame:
    return _turns(spark, folder)[1].select(F.col("scope").alias("memory_id"), F.col("id").alias("turn_no"), "term", "tf", "length")


def topk_exact(spark: SparkSession, folder: str) -> DataFrame:
    return _exact(spark, folder, _turns(spark, folder))


def _exact(spark: SparkSession, folder: str, turns: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    t, post, _ = turns
    return S.exact(asked(spark, folder), post, t.select(F.col("turn_no").alias("id"), F.col("raw_text").alias("text")), K)


def topk_bm25(spark: SparkSession, folder: str) -> DataFrame:
    _, post, sizes = _turns(spark, folder)
    return S.bm25(asked(spark, folder), post, sizes, K, _frequencies(spark, folder))


def topk_session_bm25(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 with a session as document; a term's tf is the number of the session's turns with it."""
    index = LexicalIndex(spark, folder, "sessions")
    return S.bm25(asked(spark, folder), index.read("postings"), index.read("sizes"), K, index.read("df"))


def topk_lexical_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return S.lexical_hits(asked(spark, folder), _turns(spark, folder)[1], K)


def num_coverage(spark: SparkSession, folder: str) -> DataFrame:
    _, post, sizes = _turns(spark, folder)
    return S.coverage(asked(spark, folder), post, sizes, _frequencies(spark, folder))


def num_idf(spark: SparkSession, folder: str) -> DataFrame:
    sizes = _turns(spark, folder)[2]
    return _frequencies(spark, folder).join(sizes, "scope").select(F.col("scope").alias("memory_id"), "term", F.round(S.idf(F.col("total"), F.col("df")), 6).alias("idf"))


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), e


def topk_dense(spark: SparkSession, folder: str) -> DataFrame:
    q, e = _vectors(spark, folder)
    return S.dense(q, e, K)


def topk_dense_subset(spark: SparkSession, folder: str) -> DataFrame:
    """Only the vectors of label 1 to 3 are searched."""
    q, e = _vectors(spark, folder)
    return S.dense(q, e.where("label between 1 and 3"), K)


def vec_dot(spark: SparkSession, folder: str) -> DataFrame:
    e = _vectors(spark, folder)[1]
    return e.select("id", F.round(V.dot(F.col("vector"), F.reverse("vector")), 5).alias("dot"))


def vec_norm(spark: SparkSession, folder: str) -> DataFrame:
    e = _vectors(spark, folder)[1]
    n = V.normalized(F.col("vector"))
    return e.select("id", F.round(V.norm(F.col("vector")), 5).alias("norm"), F.round(V.norm(n), 5).alias("unit_norm"), F.round(n[0], 5).alias("first"))


def vec_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Centroid of each label, one row per dimension."""
    e = _vectors(spark, folder)[1]
    return e.select("label", F.posexplode("vector").alias("dim", "x")).groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


def vec_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Hashed term vectors of the queries: length and sum of signs stay within the number of terms."""
    q = asked(spark, folder)
    h = V.hashed(content_terms(F.col("query")))
    return q.select("query_id", F.size(h).alias("dims"), F.size(content_terms(F.col("query"))).alias("n_terms"), F.aggregate(h, F.lit(0.0), lambda s, x: s + F.abs(x)).alias("mass"))


def channels(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, channel, id, score, rank) of exact, BM25 and lexical hits over one set of postings."""
    turns = _turns(spark, folder)
    q, (_, post, sizes) = asked(spark, folder), turns
    parts = {"exact": _exact(spark, folder, turns), "bm25": S.bm25(q, post, sizes, K, _frequencies(spark, folder)), "lexical": S.lexical_hits(q, post, K)}
    return cut(reduce(DataFrame.unionByName, (p.withColumn("channel", F.lit(c)) for c, p in parts.items())))


def win_rrf(spark: SparkSession, folder: str) -> DataFrame:
    return U.reciprocal_ranks(channels(spark, folder))


def win_minmax(spark: SparkSession, folder: str) -> DataFrame:
    return channels(spark, folder).select("query_id", "channel", "id", F.round(U.min_max(F.col("score"), ["query_id", "channel"]), 6).alias("scaled"))


def win_consensus(spark: SparkSession, folder: str) -> DataFrame:
    view = F.when(F.col("channel") == "exact", "owner").when(F.col("channel") == "bm25", "full_query").otherwise("scope_predicate")
    return U.consensus(channels(spark, folder).withColumn("view", view))


def _fused(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, id, session_id, exact, bm25, lexical, fused, coverage): channels side by side, missing ones 0."""
    wide = channels(spark, folder).groupBy("query_id", "id").pivot("channel", ["exact", "bm25", "lexical"]).agg(F.max("score")).na.fill(0.0)
    parts = {"exact": F.col("exact"), "bm25": F.col("bm25") / 20, "role": F.col("lexical")}
    t = table(spark, folder, "turns", "turn_no", "session_id").withColumnRenamed("turn_no", "id")
    return wide.select("*", F.round(U.weighted(U.FUSION, parts), 9).alias("fused"), F.round(U.weighted(U.COVERAGE, {**parts, "role": F.lit(0.0)}), 9).alias("coverage")).join(t, "id")


def topk_fused(spark: SparkSession, folder: str) -> DataFrame:
    f = _fused(spark, folder)
    return S.top(f.select("query_id", "id", F.col("fused").alias("score")), ["query_id"], K)


def topk_coverage_lane(spark: SparkSession, folder: str) -> DataFrame:
    f = _fused(spark, folder)
    return S.top(f.select("query_id", "id", F.col("coverage").alias("score")), ["query_id"], K)


def win_session_best(spark: SparkSession, folder: str) -> DataFrame:
    f = _fused(spark, folder)
    return f.select("query_id", "id", "session_id", F.max("fused").over(Window.partitionBy("query_id", "session_id")).alias("session_score"))


def win_per_session_quota(spark: SparkSession, folder: str) -> DataFrame:
    f = _fused(spark, folder)
    ranked = f.select("query_id", "session_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("fused").desc(), "id")).alias("rank"))
    return U.per_session_quota(ranked, 8).select("query_id", "id", "place")


def win_dual_lane(spark: SparkSession, folder: str) -> DataFrame:
    return U.dual_lane(_fused(spark, folder).select("query_id", "id", "fused", "coverage"), 12, 4)


def win_round_robin(spark: SparkSession, folder: str) -> DataFrame:
    return U.round_robin(channels(spark, folder).withColumnRenamed("channel", "operand_id"), 12)


def flt_adaptive_limit(spark: SparkSession, folder: str) -> DataFrame:
    """Turns a question may spend of 32: by kind of answer and wording."""
    from turnloom.functions.text import slots

    q = table(spark, folder, "questions", "question_id", "question")
    s = slots(F.col("question"))
    timed = F.lower("question").rlike(TIMED)
    many = s["is_count"] | s["is_list"]
    target = F.when(many, F.greatest(F.lit(24), F.lit(16))).when(timed, F.greatest(F.lit(24), F.lit(12))).otherwise(F.greatest(F.lit(12), F.lit(16)))
    return q.select("question_id", F.greatest(F.lit(1), F.least(F.lit(32), target)).alias("turn_limit"))


# Fixed value: wording that asks for a time.
TIMED = r"\b(when|what\s+time|how\s+long|how\s+many\s+(days?|weeks?|months?|years?)|before|after|first|last|earlier|later|ago|yesterday|tomorrow|past\s+weekend|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"

QUERIES = {f.__name__: f for f in (
    agg_df, agg_postings, topk_exact, topk_bm25, topk_session_bm25, topk_lexical_nodes, num_coverage, num_idf, topk_dense, topk_dense_subset, vec_dot, vec_norm, vec_mean, vec_hash,
    win_rrf, win_minmax, win_consensus, topk_fused, topk_coverage_lane, win_session_best, win_per_session_quota, win_dual_lane, win_round_robin, flt_adaptive_limit,
)}

_BASE = f"""q AS (SELECT question_id AS query_id, memory_id AS scope, list_distinct({sql_content('question')}) AS words FROM questions WHERE CAST(split_part(question_id, '_', 3) AS INT) % 20 = 0),
 qt AS (SELECT query_id, scope, len(words) AS n_terms, unnest(words) AS term FROM q),
 d AS (SELECT memory_id AS scope, turn_no AS id, {sql_content('raw_text')} AS words FROM turns),
 p AS (SELECT scope, id, length, term, count(*) AS tf FROM (SELECT scope, id, len(words) AS length, unnest(words) AS term FROM d) GROUP BY ALL),
 df AS (SELECT scope, term, count(*) AS df FROM p GROUP BY ALL),
 sz AS (SELECT scope, count(*) AS total, coalesce(sum(len(words)), 0) / count(*) AS average FROM d GROUP BY scope)"""
_TOP = "(SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {0} QUALIFY rank <= 10)"
_CHANNELS = f"""{_BASE},
 ex AS (SELECT query_id, id, round(shared / n_terms + CASE WHEN contains(lower(raw_text), array_to_string(list_sort(words), ' ')) THEN 0.5 ELSE 0 END, 6) AS score
  FROM (SELECT query_id, id, n_terms, count(*) AS shared FROM qt JOIN p USING (scope, term) GROUP BY ALL) JOIN q USING (query_id) JOIN turns ON turn_no = id),
 bm AS (SELECT query_id, id, round(sum(ln(1 + (total - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / greatest(1.0::DOUBLE, average)))), 6) AS score
  FROM qt JOIN df USING (scope, term) JOIN sz USING (scope) JOIN p USING (scope, term) GROUP BY ALL HAVING score > 0),
 lx AS (SELECT query_id, id, round(count(*) / n_terms, 6) AS score FROM qt JOIN p USING (scope, term) GROUP BY query_id, id, n_terms),
 c AS (SELECT *, 'exact' AS channel FROM {_TOP.format('ex')} UNION ALL SELECT *, 'bm25' FROM {_TOP.format('bm')} UNION ALL SELECT *, 'lexical' FROM {_TOP.format('lx')})"""
_FUSED = f"""{_CHANNELS}, w AS (SELECT query_id, id, coalesce(max(score) FILTER (channel = 'exact'), 0) AS e, coalesce(max(score) FILTER (channel = 'bm25'), 0) AS b, coalesce(max(score) FILTER (channel = 'lexical'), 0) AS l FROM c GROUP BY ALL),
 f AS (SELECT query_id, id, session_id, round(1.2::DOUBLE * e + b / 20 + 0.25::DOUBLE * l, 9) AS fused, round(1.2::DOUBLE * e + b / 20, 9) AS coverage FROM w JOIN turns ON turn_no = id)"""
_DENSE = """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), s AS (SELECT a.id AS query_id, b.id AS id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a, e b WHERE a.id % 20 = 0 {0})
 SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10"""

SQL = {
    "flt_adaptive_limit": f"WITH k AS ({_SLOTS}) SELECT question_id, CASE WHEN is_count OR is_list THEN 24 WHEN regexp_matches(lower(question), '{TIMED}') THEN 24 ELSE 16 END AS turn_limit FROM k JOIN questions USING (question_id)",
    "agg_df": f"WITH w AS (SELECT DISTINCT turn_no, memory_id, session_id, unnest({sql_content('raw_text')}) AS term FROM turns) SELECT memory_id, term, count(*) AS turns, count(DISTINCT session_id) AS sessions FROM w GROUP BY ALL",
    "agg_postings": f"WITH {_BASE} SELECT scope AS memory_id, id AS turn_no, term, tf, length FROM p",
    "topk_exact": f"WITH {_CHANNELS} SELECT query_id, id, score, rank FROM c WHERE channel = 'exact'",
    "topk_bm25": f"WITH {_CHANNELS} SELECT query_id, id, score, rank FROM c WHERE channel = 'bm25'",
    "topk_lexical_nodes": f"WITH {_CHANNELS} SELECT query_id, id, score, rank FROM c WHERE channel = 'lexical'",
    "topk_session_bm25": f"""WITH {_BASE}, sp AS (SELECT memory_id AS scope, session_id AS id, term, count(*) AS tf FROM (SELECT DISTINCT turn_no, memory_id, session_id, unnest({sql_content('raw_text')}) AS term FROM turns) GROUP BY ALL),
 sl AS (SELECT scope, id, sum(tf) AS length FROM sp GROUP BY ALL), ss AS (SELECT scope, count(*) AS total, avg(length) AS average FROM sl GROUP BY scope), sd AS (SELECT scope, term, count(*) AS df FROM sp GROUP BY ALL),
 bm AS (SELECT query_id, id, round(sum(ln(1 + (total - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / greatest(1.0::DOUBLE, average)))), 6) AS score
  FROM qt JOIN sd USING (scope, term) JOIN ss USING (scope) JOIN sp USING (scope, term) JOIN sl USING (scope, id) GROUP BY ALL HAVING score > 0) SELECT * FROM {_TOP.format('bm')}""",
    "num_coverage": f"""WITH {_BASE}, a AS (SELECT query_id, scope, term, ln(1 + total / (1 + coalesce(df, 0))) AS weight FROM qt JOIN sz USING (scope) LEFT JOIN df USING (scope, term)), w AS (SELECT query_id, sum(weight) AS whole FROM a GROUP BY ALL)
 SELECT query_id, id, round(sum(weight) / any_value(whole), 6) AS coverage FROM a JOIN p USING (scope, term) JOIN w USING (query_id) GROUP BY query_id, id""",
    "num_idf": f"WITH {_BASE} SELECT scope AS memory_id, term, round(ln(1 + (total - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM df JOIN sz USING (scope)",
    "topk_dense": _DENSE.format(""),
    "topk_dense_subset": _DENSE.format("AND b.label BETWEEN 1 AND 3"),
    "vec_dot": "SELECT vec_id AS id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])), 5) AS dot FROM embeddings",
    "vec_norm": "WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM e) SELECT id, round(n, 5) AS norm, 1.0::DOUBLE AS unit_norm, round(v[1] / n, 5) AS first FROM n",
    "vec_mean": "WITH e AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT label, CAST(dim AS INT) AS dim, round(avg(x), 5) AS mean FROM e GROUP BY ALL",
    "win_rrf": f"WITH {_CHANNELS} SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf FROM c GROUP BY ALL",
    "win_minmax": f"WITH {_CHANNELS}, m AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM c WINDOW w AS (PARTITION BY query_id, channel)) SELECT query_id, channel, id, CASE WHEN hi > lo THEN round((score - lo) / (hi - lo), 6) ELSE 1.0::DOUBLE END AS scaled FROM m",
    "win_consensus": f"WITH {_CHANNELS} SELECT query_id, id, round(sum(CASE channel WHEN 'bm25' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END / (60 + rank)), 9) AS consensus FROM c WHERE channel <> 'exact' GROUP BY ALL",
    "topk_fused": f"WITH {_FUSED}, g AS (SELECT query_id, id, fused AS score FROM f) SELECT * FROM {_TOP.format('g')}",
    "topk_coverage_lane": f"WITH {_FUSED}, g AS (SELECT query_id, id, coverage AS score FROM f) SELECT * FROM {_TOP.format('g')}",
    "win_session_best": f"WITH {_FUSED} SELECT query_id, id, session_id, max(fused) OVER (PARTITION BY query_id, session_id) AS session_score FROM f",
    "win_per_session_quota": f"""WITH {_FUSED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) AS rk FROM f), n AS (SELECT query_id, count(DISTINCT session_id) AS n FROM f GROUP BY ALL),
 o AS (SELECT r.*, n, row_number() OVER (PARTITION BY query_id, session_id ORDER BY rk) AS own FROM r JOIN n USING (query_id)) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY own > greatest(1, 8 // n), rk) AS place FROM o QUALIFY place <= 8""",
    "win_dual_lane": f"""WITH {_FUSED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) - 1 AS pr, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, fused DESC, id) - 1 AS cr, count(*) OVER (PARTITION BY query_id) AS n FROM f),
 h AS (SELECT *, pr < least(n, 12, 4, 6) AS head, round(1.0::DOUBLE / (60 + pr) + 1.0::DOUBLE / (60 + cr), 9) AS rr FROM r)
 SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY NOT head, CASE WHEN head THEN pr ELSE 0 END, rr DESC, cr, pr, id) AS place, head FROM h""",
    "win_round_robin": f"WITH {_CHANNELS}, m AS (SELECT query_id, id, min((rank, channel)) AS pos FROM c GROUP BY ALL) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pos, id) AS place FROM m QUALIFY place <= 12",
    "vec_hash": f"""WITH {_BASE}, h AS (SELECT query_id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 256 AS place, CASE WHEN CAST('0x' || substr(md5(term), 9, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS sg FROM qt), p1 AS (SELECT query_id, place, abs(sum(sg)) AS m FROM h GROUP BY ALL), n1 AS (SELECT query_id, sum(m) AS mass FROM p1 GROUP BY ALL)
 SELECT q.query_id, 256 AS dims, CAST(len(words) AS INT) AS n_terms, CAST(coalesce(mass, 0) AS DOUBLE) AS mass FROM q LEFT JOIN n1 USING (query_id)""",
}
