"""Operator: texts decoded with the wrong character encoding, and their original wording.

A character trigram model is trained on all clean records, by way of one table of their distinct tokens with
their counts.  Every token with a character beyond ASCII is
put through the candidate chains (encode with the charset that was wrongly used, decode with the right
one, up to three times); the likeliest reading is accepted where its log likelihood leads the token's own
by more than the margin, which is validated on all clean tokens.  Tokens that hold replacement signs or
control codes, or scraps of broken sequences, count as garbled beyond recovery.
"""

from __future__ import annotations

import re
from collections import Counter, OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.ngrams import flatten, grams
from turnloom.plans.lineage import cut

BITS = 18
#: Tokens whose verdict a worker remembers.
REMEMBERED = 200_000
MARGIN, WORST_MARGIN = 2.5, 16.0
#: Bins of the histogram of leads, and bins to a unit of lead: it reaches to the worst margin.
BINS, PER_NAT = 16 * 1024, 1024
#: Lead from which a reading keeps its token out of the second training.
DOUBT = 0.0
#: Log prior of one chain step, and of one that swaps two one-byte charsets.
STEP, SWAP = -2.0, -5.0
# Charsets UTF-8 bytes were read in; (read in, written in) of one-byte charsets.
READ_IN = ["latin-1", "cp1252", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "koi8-r", "cp866", "iso8859-2", "iso8859-15"]
SWAPPED = [
    ("latin-1", "cp1251"), ("cp1252", "cp1251"), ("latin-1", "koi8-r"), ("cp1252", "koi8-r"), ("latin-1", "cp866"), ("cp1252", "cp866"), ("latin-1", "iso8859-5"),
    ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("koi8-r", "cp866"), ("cp866", "koi8-r"), ("mac_roman", "cp1251"), ("mac_cyrillic", "cp1251"),
    ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp1252", "cp437"), ("cp850", "cp1252"), ("cp1252", "cp850"),
    ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("cp866", "cp1252"), ("cp437", "cp866"), ("cp437", "koi8-r"), ("cp437", "cp1251"),
]
_TOKEN = re.compile(r"[^ \t\r\n]+")
_LOST = re.compile("[�\x80-\x84\x86-\x9f]")
#: Characters beyond ASCII that are more than spacing: a token without one has no other reading.
_TELLING = re.compile("[^\x00-\x7f\xa0\xad\u200b-\u200f\u202f\u2060\ufeff]")
#: Marks of wrong decoding, to keep such records out of training. None holds a blank, so a token tells.
_MARKS = re.compile(
    "[\x80-\x9f\ufffd\u2500-\u257f\u2580-\u259f√∂⌠⌡≈∏∑∫Ω∆◊≠≤≥∞ﬁﬂˆ˜¯˘˙˚˝˛ˇΓΘΣΦτδφε∩≡⌐¬½¼ĂĹ]"
    "|[\xc2-\xf4][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
    "|[\xc0-\xff]{4}|[А-Я]{4}|[РСГв][\xa0-\xbfЂ-Џђ-џ‘-™]"
)


def _charset(name: str) -> list[str]:
    """Characters of the 256 bytes; bytes without one stand for the control code of their number."""
    return [bytes([b]).decode(name, "ignore") or chr(b) for b in range(256)]


_CHARS = {n: _charset(n) for n in {*READ_IN, *(a for pair in SWAPPED for a in pair)}}
_BYTES = {n: {c: b for b, c in reversed(list(enumerate(cs)))} for n, cs in _CHARS.items()}


def _encoded(text: str, charset: str) -> bytes | None:
    table = _BYTES[charset]
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def readings(token: str) -> list[tuple[str, str, float]]:
    """Other readings of a token: (text, chain, log prior)."""
    found: dict[str, tuple[str, float]] = {}
    front = [(token, "", 0.0)]
    for _ in range(3):
        then = []
        for text, chain, prior in front:
            for charset in READ_IN:
                raw = _encoded(text, charset)
                if raw is None:
                    continue
                try:
                    new = raw.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if new != text and new not in found and new != token:
                    found[new] = (f"{chain}{charset}>utf-8 ", prior + STEP)
                    then.append((new, *found[new]))
        front = then
    for read, written in SWAPPED:
        raw = _encoded(token, read)
        if raw is not None:
            new = "".join(_CHARS[written][b] for b in raw)
            if new != token and new not in found:
                found[new] = (f"{read}>{written} ", SWAP)
    return [(text, chain.strip(), prior) for text, (chain, prior) in found.items()]


@dataclass(frozen=True)
class CharacterModel:
    """Counts of hashed one-, two- and three-grams; of fixed size whatever the corpus."""

    counts: np.ndarray  # (3, 2**BITS)

    def scores(self, tokens: list[str]) -> np.ndarray:
        """Log likelihood of each token between word marks."""
        codes, starts = flatten(["\1\1" + t + "\1" for t in tokens])
        one, two, three = (grams(codes, n, BITS) for n in (1, 2, 3))
        c1, c2, c3 = self.counts
        total = max(1.0, c1.sum())
        p = 0.00009 + 0.009 * c1[one[2:]].astype("f8") / total
        p = p + 0.09 * c2[two[1:]] / np.maximum(1, c1[one[1:-1]])
        p = p + 0.9 * c3[three] / np.maximum(1, c2[two[:-1]])
        running = np.concatenate([[0, 0, 0], np.cumsum(np.log(np.minimum(p, 1.0)), dtype="f8")])
        # running[i + 1]: up to the character at i; a token's own begin behind its two marks.
        return running[starts[1:] - 1] - running[starts[:-1] + 2] if len(tokens) else np.zeros(0)


    def knows(self, tokens: list[str]) -> np.ndarray:
        """Whether every character of each token occurs in the corpus."""
        codes, starts = flatten(["\1" + t for t in tokens])
        seen = (self.counts[0][grams(codes, 1, BITS)] > 0) | (codes == 0)
        return np.minimum.reduceat(seen, starts[:-1]) if len(tokens) else np.zeros(0, bool)


def _tokens_of_clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of texts without marks: a row for each text (h, its distinct tokens beyond ASCII), and rows without h of tokens and how often they occur."""
    marked: dict[str, bool] = {}
    counts: Counter = Counter()

    def summed(few: int) -> Iterator[pd.DataFrame]:
        if len(counts) > few:
            rows = list(counts.items())
            counts.clear()
            parts = [rows[k : k + 5000] for k in range(0, len(rows), 5000)]
            yield pd.DataFrame({"h": None, "tokens": [[t for t, _ in x] for x in parts], "n": [[c for _, c in x] for x in parts]})

    for b in batches:
        out = []
        for h, text in zip(b["h"], b["text"]):
            words = _TOKEN.findall(text)
            special = {t for t in words if not t.isascii()}
            for t in special:
                if t not in marked:
                    marked[t] = _MARKS.search(t) is not None
            if not any(marked[t] for t in special):
                counts.update(words)
                if special:
                    out.append((h, sorted(special)))
        if len(marked) > REMEMBERED:
            marked.clear()
        yield pd.DataFrame({"h": [x[0] for x in out], "tokens": [x[1] for x in out], "n": None})
        yield from summed(REMEMBERED)
    yield from summed(0)


def token_table(documents: DataFrame) -> DataFrame:
    """(token, n, n_texts, texts, chains, priors) of all clean records: how often a token occurs, in how many distinct texts, and its other readings.

    Records are read once; only their distinct tokens move.  ``n_texts`` and the readings are of tokens beyond ASCII.
    """
    texts = documents.where(F.length("text") > 0).select(F.md5("text").alias("h"), "text")
    got = cut(texts.mapInPandas(_tokens_of_clean, "h string, tokens array<string>, n array<bigint>"))
    often = got.where("h is null").select(F.explode(F.arrays_zip("tokens", "n")).alias("x")).select("x.tokens", "x.n").toDF("token", "n")
    spread = got.where("h is not null").select("h", "tokens").dropDuplicates(["h"]).select(F.explode("tokens").alias("token"))
    both = often.withColumn("n_texts", F.lit(0)).unionByName(spread.select("token", F.lit(0).alias("n"), F.lit(1).alias("n_texts")))
    table = both.groupBy("token").agg(F.sum("n").cast("bigint").alias("n"), F.sum("n_texts").cast("bigint").alias("n_texts"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [readings(t) if _TELLING.search(t) else [] for t in b["token"]]
            yield b.assign(texts=[[x[0] for x in r] for r in found], chains=[[x[1] for x in r] for r in found], priors=[[x[2] for x in r] for r in found])

    return cut(table.mapInPandas(read, "token string, n bigint, n_texts bigint, texts array<string>, chains array<string>, priors array<double>"))


def _counted(table: DataFrame, known: CharacterModel | None) -> CharacterModel:
    """Counts over the tokens of a table: by partition, then added by bucket. ``known`` drops tokens it reads better otherwise."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((3, 1 << BITS), "i8")
        for b in batches:
            if known is not None:
                b = b[_leads(b, known) < DOUBT]
            if not len(b):
                continue
            codes, starts = flatten(["\1\1" + t + "\1" for t in b["token"]])
            weight = np.concatenate([[0], np.repeat(b["n"].to_numpy("f8"), np.diff(starts))])
            ends = codes == 0
            for n in (1, 2, 3):
                h = grams(codes, n, BITS)
                inside = ~np.logical_or.reduce([ends[k : len(codes) - n + 1 + k] for k in range(n)]) if len(h) else np.zeros(0, bool)
                sums[n - 1] += np.bincount(h[inside].astype("i8"), weight[: len(h)][inside], 1 << BITS).astype("i8")
        n, bucket = np.nonzero(sums)
        yield pd.DataFrame({"n": n.astype("i4"), "bucket": bucket.astype("i4"), "c": sums[n, bucket]})

    parts = table.mapInPandas(count, "n int, bucket int, c bigint")
    rows = parts.groupBy("n", "bucket").agg(F.sum("c").alias("c")).toPandas()  # 3 * 2**BITS rows at most
    counts = np.zeros((3, 1 << BITS), "f4")
    counts[rows["n"].to_numpy("i8"), rows["bucket"].to_numpy("i8")] = rows["c"].to_numpy("f4")
    return CharacterModel(counts)


def trained(table: DataFrame) -> CharacterModel:
    """The model of a token table: first of all its tokens, then of those the first finds nothing better for."""
    return _counted(table, _counted(table, None))


def train(documents: DataFrame) -> CharacterModel:
    """The model of all clean texts."""
    return trained(token_table(documents))


def _scored(tokens: list[str], options: list[list[tuple[str, str, float]]], model: CharacterModel) -> list[tuple[float, str, str]]:
    own = model.scores(tokens)
    flat = [r[0] for o in options for r in o]
    flat = np.where(model.knows(flat), model.scores(flat), -np.inf)
    out, k = [], 0
    for o, mine in zip(options, own):
        best = (-1e9, "", "")
        for text, chain, prior in o:
            best = max(best, (flat[k] + prior - mine, text, chain))
            k += 1
        out.append(best)
    return out


def _leads(rows: pd.DataFrame, model: CharacterModel) -> np.ndarray:
    """The lead of the likeliest other reading of each row of a token table."""
    options = [list(zip(*r)) for r in zip(rows["texts"], rows["chains"], rows["priors"])]
    return np.array([x[0] for x in _scored(list(rows["token"]), options, model)])


def best_readings(tokens: list[str], model: CharacterModel) -> list[tuple[float, str, str]]:
    """For each token the lead of its likeliest other reading, that reading and its chain."""
    return _scored(tokens, [readings(t) if _TELLING.search(t) else [] for t in tokens], model)


def lead_counts(table: DataFrame, model: CharacterModel) -> np.ndarray:
    """Number of clean tokens by the bin of their lead, each token once per distinct clean text; the first and last bin are open."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(BINS + 1, "i8")
        for b in batches:
            np.add.at(sums, np.clip(np.floor(_leads(b, model) * PER_NAT), 0, BINS).astype("i8"), b["n_texts"].to_numpy("i8"))
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"bin": at.astype("i4"), "c": sums[at]})

    rows = table.where("n_texts > 0").mapInPandas(count, "bin int, c bigint").groupBy("bin").agg(F.sum("c").alias("c")).toPandas()  # BINS + 1 rows at most
    out = np.zeros(BINS + 1, "i8")
    out[rows["bin"].to_numpy("i8")] = rows["c"].to_numpy("i8")
    return out


def lead_histogram(documents: DataFrame, model: CharacterModel) -> np.ndarray:
    """``lead_counts`` of the clean records of documents."""
    return lead_counts(token_table(documents), model)


def validated_margin(table: DataFrame, model: CharacterModel) -> float:
    """The lead that one clean token in 500 reaches, over all distinct clean texts, held between ``MARGIN`` and ``WORST_MARGIN``."""
    up_to = np.cumsum(lead_counts(table, model))
    lead = np.searchsorted(up_to, 0.998 * (up_to[-1] - 1), "right") / PER_NAT if up_to[-1] else 0.0
    return float(np.clip(lead + 1, MARGIN, WORST_MARGIN))


class _Leads:
    """``best_readings`` with a bounded memory."""

    def __init__(self, model: CharacterModel | None) -> None:
        self.model, self.known = model, OrderedDict()

    def of(self, tokens: set[str]) -> dict[str, tuple[float, str, str]]:
        new = [t for t in tokens if t not in self.known]
        self.known.update(zip(new, best_readings(new, self.model)))
        got = {t: self.known[t] for t in tokens}
        while len(self.known) > REMEMBERED:
            self.known.popitem(last=False)
        return got


def is_scrap(token: str) -> bool:
    """Whether lead bytes of UTF-8, read in a one-byte charset, stand before signs no word holds there."""
    return bool(re.search("[ÃÂ][\xa0-¿ƒ‚-…]|â[\u0080-¿€]|[ÐÑ][\u0080-¿]", token))


def garbled_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, repaired_text, n_garbled, n_repaired, chains) of each document with a garbled token.

    Null and empty texts are never garbled.  ``repaired_text`` has every recoverable token replaced; lost
    ones stay.  Documents are read twice: for the table of clean tokens, on which the model is trained and the
    margin validated, and to be judged.
    """
    texts = documents.select("doc_id", "text")
    table = token_table(texts)
    model = trained(table)
    margin = validated_margin(table, model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leads = _Leads(model)
        for b in batches:
            found = [[x for x in _TOKEN.findall(t) if not x.isascii()] for t in b["text"]]
            known = leads.of({t for ts in found for t in ts})
            better = {t: x for t, x in known.items() if x[0] > margin and not _LOST.search(x[1])}
            lost = {t for t in known if t not in better and (_LOST.search(t) or is_scrap(t))}
            out = []
            for doc, text, tokens in zip(b["doc_id"], b["text"], found):
                mended = [t for t in tokens if t in better]
                bad = len(mended) + sum(t in lost for t in tokens)
                if bad:
                    fixed = _TOKEN.sub(lambda m: better[m[0]][1] if m[0] in better else m[0], text)
                    out.append((doc, fixed, bad, len(mended), sorted({better[t][2] for t in mended})))
            yield pd.DataFrame(out, columns=["doc_id", "repaired_text", "n_garbled", "n_repaired", "chains"])

    return texts.where(F.col("text").rlike(r"[^\x00-\x7f]")).mapInPandas(judge, "doc_id bigint, repaired_text string, n_garbled int, n_repaired int, chains array<string>")
