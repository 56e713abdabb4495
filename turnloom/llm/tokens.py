"""Operator: token counts under a public tokenizer, kept by content, and token cubes updated by signed deltas."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.plans.lineage import cut

#: Folder of the vocabulary files and the rank file used; both are parameters of every function that counts.
FOLDER, RANKS = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Contents whose count a worker remembers.
REMEMBERED = 200_000
#: Unseen contents (of 32 bytes) up to which they go to the texts; beyond, texts and contents meet by shuffle.
FEW = 250_000
# Language codes by their other spellings.
LANGUAGES = {
    "en": ["en", "eng", "english"], "de": ["de", "deu", "ger", "german", "deutsch"], "es": ["es", "spa", "spanish"],
    "fr": ["fr", "fra", "fre", "french"], "pt": ["pt", "por", "portuguese"], "ru": ["ru", "rus", "russian"],
}

COUNTS = "content_hash binary, n_tokens bigint"


def tokenizer_hash(folder: str = FOLDER, ranks: str = RANKS) -> str:
    """Hash of the vocabulary and the splitting pattern: counts of one hash may be reused."""
    with open(os.path.join(folder, ranks), "rb") as f:
        return hashlib.sha256(f.read() + PATTERN.encode()).hexdigest()[:16]


@lru_cache(maxsize=4)
def encoder(folder: str, ranks: str, tokenizer: str | None = None):
    """The tokenizer, built once per worker; refused where the worker's files are not those of the hash ``tokenizer``."""
    import tiktoken

    if tokenizer is not None and tokenizer_hash(folder, ranks) != tokenizer:
        raise ValueError(f"{ranks} on this worker is not tokenizer {tokenizer}")

    with open(os.path.join(folder, ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def content_hash(text: Column) -> Column:
    """32 bytes that stand for a text; null for null."""
    return F.unhex(F.sha2(text, 256))


def language(lang: Column) -> Column:
    """Two-letter code of a language in any spelling; ``und`` for null or unknown."""
    base = F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]+)", 1)
    cases = F.lit(None).cast("string")
    for code, spellings in LANGUAGES.items():
        cases = F.when(base.isin(spellings), code).otherwise(cases)
    return F.coalesce(cases, F.lit("und"))


def label(value: Column) -> Column:
    """Lower-case name without outer blanks; ``unknown`` for null or empty."""
    v = F.lower(F.trim(value))
    return F.when(F.length(v) > 0, v).otherwise("unknown")


def count_tokens(texts: DataFrame, known: DataFrame | None = None, folder: str = FOLDER, ranks: str = RANKS) -> DataFrame:
    """(content_hash, n_tokens) of the contents of ``texts`` (content_hash, text) that ``known`` does not hold yet.

    Null texts have no content.  Without ``known`` texts are encoded where they are read and only hashes and
    counts move; with it, only texts of unseen contents are encoded.
    """
    rows, tokenizer = texts.where("text is not null"), tokenizer_hash(folder, ranks)
    if known is not None:
        unseen = cut(rows.select("content_hash").distinct().join(known.select("content_hash"), "content_hash", "left_anti"))
        rows = rows.join(F.broadcast(unseen) if unseen.count() <= FEW else unseen, "content_hash", "left_semi")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, seen = encoder(folder, ranks, tokenizer), {}
        for b in batches:
            out = []
            for h, text in zip(b["content_hash"], b["text"]):
                h = bytes(h)
                if h not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[h] = len(bpe.encode_ordinary(text))
                    out.append((h, seen[h]))
            yield pd.DataFrame(out, columns=["content_hash", "n_tokens"])

    return rows.select("content_hash", "text").mapInPandas(encode, COUNTS).groupBy("content_hash").agg(F.max("n_tokens").alias("n_tokens"))


def token_cube(assigned: DataFrame, counts: DataFrame, dims: list[str]) -> DataFrame:
    """(dims, n_rows, n_tokens): rows with content_hash and ``dims`` are counted per content before they meet their tokens."""
    return weighed(held_contents(assigned, dims), counts, dims)


def held_contents(rows: DataFrame, dims: list[str]) -> DataFrame:
    """(content_hash, dims, n): how many rows hold each content in each cell."""
    return rows.groupBy("content_hash", *dims).agg(F.count(F.lit(1)).alias("n"))


def weighed(held: DataFrame, counts: DataFrame, dims: list[str]) -> DataFrame:
    """(dims, n_rows, n_tokens) of contents held ``n`` times; ``n`` may be negative."""
    return held.join(counts, "content_hash", "left").groupBy(*dims).agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") * F.coalesce("n_tokens", F.lit(0))).alias("n_tokens"))


def deltas(before: DataFrame, after: DataFrame, counts: DataFrame, dims: list[str]) -> DataFrame:
    """Signed change of the cube from two states (content_hash, dims, n): what left counts less, what came counts more.

    What both states hold cancels before tokens are looked up; ``counts`` must hold both states' contents.
    """
    signed = before.withColumn("n", -F.col("n")).unionByName(after).groupBy("content_hash", *dims).agg(F.sum("n").alias("n")).where("n <> 0")
    return weighed(signed, counts, dims)


def merge_cubes(cube: DataFrame, change: DataFrame, dims: list[str]) -> DataFrame:
    """The cube after a signed change; cells without rows vanish."""
    return cube.unionByName(change).groupBy(*dims).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_tokens").alias("n_tokens")).where("n_rows <> 0")


def document_rows(documents: DataFrame, *more: str) -> DataFrame:
    """(doc_id, content_hash, source, language, topic) of documents, in canonical spelling, and the columns ``more``."""
    return documents.select("doc_id", *more, content_hash(F.col("text")).alias("content_hash"), label(F.col("source")).alias("source"), language(F.col("lang")).alias("language"), label(F.col("topic")).alias("topic"))


class TokenLedger:
    """Counts, contents held and cube of one corpus as numbered versions in a shared folder.

    ``counts`` of a version has the contents first met in it (with their tokenizer's hash), ``held`` how many
    rows hold each content in each cell of ``dims``.  A version is whole once its ``cube`` is written, which
    is written last; earlier versions stay readable.
    """

    def __init__(self, spark: SparkSession, folder: str, vocabulary: str = FOLDER, ranks: str = RANKS, dims: tuple[str, ...] = ("source", "language", "topic")) -> None:
        self.spark, self.folder, self.vocabulary, self.ranks, self.dims = spark, folder.rstrip("/"), vocabulary, ranks, list(dims)
        self.tokenizer = tokenizer_hash(vocabulary, ranks)

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def version(self) -> int:
        """Latest whole version; 0 if none."""
        v = 0
        while self._exists(f"{self.folder}/v{v + 1:06d}/cube/_SUCCESS"):
            v += 1
        return v

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """``held`` or ``cube`` of a version, or the ``counts`` of all versions up to it."""
        v = self.version() if version is None else version
        return self.spark.read.parquet(*(f"{self.folder}/v{k:06d}/{name}" for k in range(1 if name == "counts" else v, v + 1)))

    def refresh(self, documents: DataFrame) -> DataFrame:
        """The cube of ``documents`` as they now are; those no longer among them are taken out."""
        return self.deliver(document_rows(documents, "text"))

    def deliver(self, rows: DataFrame) -> DataFrame:
        """The cube of all ``rows`` (content_hash, text, dims): only contents without a count under this tokenizer are encoded, the cube moves by signed deltas."""
        v = self.version()
        to = f"{self.folder}/v{v + 1:06d}"
        held_contents(rows, self.dims).write.mode("overwrite").parquet(f"{to}/held")
        after = self.spark.read.parquet(f"{to}/held")
        known = self.read("counts", v).where(F.col("tokenizer") == self.tokenizer) if v else None
        new = count_tokens(rows, known, self.vocabulary, self.ranks)
        new.withColumn("tokenizer", F.lit(self.tokenizer)).write.mode("overwrite").parquet(f"{to}/counts")
        counts = self.read("counts", v + 1).where(F.col("tokenizer") == self.tokenizer).drop("tokenizer")
        if v and self.read("cube", v).where(F.col("tokenizer") != self.tokenizer).isEmpty():
            cube = merge_cubes(self.read("cube", v).drop("tokenizer"), deltas(self.read("held", v), after, counts, self.dims), self.dims)
        else:
            cube = weighed(after, counts, self.dims)
        cube.withColumn("tokenizer", F.lit(self.tokenizer)).write.mode("overwrite").parquet(f"{to}/cube")
        return self.read("cube", v + 1).drop("tokenizer")


def turn_rows(turns: DataFrame, *more: str) -> DataFrame:
    """(memory_id, content_hash, text) of turns, and the columns ``more``."""
    return turns.select("memory_id", *more, content_hash(F.col("raw_text")).alias("content_hash"), F.col("raw_text").alias("text"))


def beside_evidence(said: DataFrame, conversations: DataFrame, answers: DataFrame) -> DataFrame:
    """(dataset, language, n_rows, n_tokens, evidence_tokens) from the turns' cube by memory and the evidence tokens that answers report.

    A memory registered twice counts once, with its latest row; memories without a row go to ``unknown``
    and ``und``.  Turns and answers are summed by memory before they meet the register.
    """
    used = answers.groupBy("memory_id").agg(F.sum("evidence_tokens").alias("evidence_tokens"))
    register = conversations.where("memory_id is not null").groupBy("memory_id").agg(F.max_by(F.struct("dataset", "lang"), "registered_at").alias("r"))
    both = said.unionByName(used, allowMissingColumns=True).groupBy("memory_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_rows", "n_tokens", "evidence_tokens")))
    placed = both.join(register, "memory_id", "left").select(label(F.col("r.dataset")).alias("dataset"), language(F.col("r.lang")).alias("language"), "n_rows", "n_tokens", "evidence_tokens")
    return placed.groupBy("dataset", "language").agg(*(F.sum(c).alias(c) for c in ("n_rows", "n_tokens", "evidence_tokens")))


def conversation_budget(turns: DataFrame, conversations: DataFrame, answers: DataFrame, folder: str = FOLDER, ranks: str = RANKS) -> DataFrame:
    """``beside_evidence`` of turns counted at once, without a ledger."""
    rows = turn_rows(turns)
    return beside_evidence(token_cube(rows, count_tokens(rows, None, folder, ranks), ["memory_id"]), conversations, answers)
