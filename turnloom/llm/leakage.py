"""Operator: held-out evaluation passages inside corpus documents.

Texts are compared as strings of letters and digits only, so case, spacing, punctuation and markup do not
count.  A document's q-grams are looked up among the passages' own; shared q-grams are counted in
overlapping diagonal bands (q-gram lemma: a stretch of L characters with e edits keeps at least
L + 1 - q - q*e of them), and bands that hold enough are aligned within the band.  A passage has leaked
if one stretch, or two in its order, hold at least half of its own words.

How many q-grams are enough follows from each passage: of L own characters in two stretches one holds L / 4,
with one edit in ``EDITS`` characters, one at least.  Where that leaves no q-gram of ten, passages have
q-grams of four; where it leaves none of these either, their words are looked for as they stand.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.ngrams import flatten, grams

#: Lengths of q-grams; a passage takes the first that its edit budget leaves one of.
GRAMS = (10, 4)
BAND = 64
#: Characters to an edit, in a stretch that counts.
EDITS = 24
#: Enough distinct q-grams in a band for any passage, and as a part of its own: more are not asked for, whatever the budget.
LEAST, LEAST_PART = 8, 0.08
#: Three words in a row that this share of the passages (and ``SHARED_LEAST`` of them) have are common wording.
SHARED, SHARED_LEAST = 0.02, 4
#: Passages looked for in one pass; more take further passes.
BLOCK = 4000
#: Part of a passage's own words that must stand in the document.
PART = 0.5
#: Q-grams that more passages hold than both of these tell none apart.
CROWD, CROWD_PART = 8, 0.03
#: Alignments that are made at once.
TOGETHER = 64
_BITS = 44
_SIEVE = 22
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_NOT = re.compile(r"[\W_]+")


def squeeze(text: str | None) -> str:
    """Letters and digits of a text in lower case, without tags; '' for null."""
    if not text:
        return ""
    if "<" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    return _NOT.sub("", unicodedata.normalize("NFKC", text).lower())


def words(text: str | None) -> list[str]:
    """Squeezed words of a passage."""
    return [w for w in (squeeze(x) for x in (text or "").split()) if w]


def common_wording(items: DataFrame) -> set[str]:
    """Runs of three words that many passages share: at most mean length / ``SHARED`` of them."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"run": [r for p in b["passage"] for w in [words(p)] for r in {" ".join(w[k : k + 3]) for k in range(len(w) - 2)}]}, dtype=object)

    n = items.count()
    least = max(SHARED_LEAST, SHARED * n)
    return {r[0] for r in items.select("passage").mapInPandas(runs, "run string").groupBy("run").count().where(F.col("count") >= least).select("run").collect()}


def bound(own: int, q: int) -> int:
    """Q-grams that the longer of two stretches keeps which hold half of ``own`` characters within the edit budget; under 1 for none."""
    stretch = -(-own // 4)
    return stretch + 1 - q - q * max(1, stretch // EDITS)


def gram_length(own: int) -> int:
    """Length of the q-grams of a passage; 0 if none would be kept."""
    return next((q for q in GRAMS if bound(own, q) >= 1), 0)


def _own_words(w: list[str], common: set[str]) -> np.ndarray:
    own = np.ones(len(w), bool)
    for k in range(len(w) - 2):
        if " ".join(w[k : k + 3]) in common:
            own[k : k + 3] = False
    return own


def _own_grams(w: list[str], own: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters, the word of each, and the q-grams that begin and end in own words with their places."""
    codes = np.frombuffer("".join(w).encode("utf-32-le"), "u4")
    at = np.repeat(np.arange(len(w)), [len(x) for x in w])
    got = grams(codes, q, _BITS)
    keep = own[at[: len(got)]] & own[at[q - 1 : q - 1 + len(got)]]
    return codes, at, got[keep], np.flatnonzero(keep)


def crowded_grams(items: DataFrame, common: set[str]) -> np.ndarray:
    """Sorted q-grams of own words that over ``CROWD_PART`` of all passages (and ``CROWD``) hold: at most mean length / ``CROWD_PART`` of them."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b["passage"]:
                own = _own_words(w := words(p), common)
                if q := gram_length(sum(len(x) for x, k in zip(w, own) if k)):
                    out.append(np.unique(_own_grams(w, own, q)[2]).view("i8"))
            yield pd.DataFrame({"gram": np.concatenate(out) if out else np.zeros(0, "i8")})

    least = max(CROWD, CROWD_PART * items.count())
    rows = items.select("passage").mapInPandas(split, "gram bigint").groupBy("gram").count().where(F.col("count") > least).select("gram").toPandas()
    return np.sort(rows["gram"].to_numpy("i8").view("u8"))


@dataclass
class Passages:
    """Index of the passages of one block that have q-grams of one length, or of those that have none (``q`` is 0)."""

    q: int
    ids: list[int]
    texts: list[np.ndarray]  # code points of each squeezed passage
    word_at: list[np.ndarray]  # word of each character
    own: list[np.ndarray]  # own words
    words: list[list[str]]
    need: np.ndarray  # distinct q-grams that a band must hold
    keys: np.ndarray  # sorted distinct q-grams
    first: np.ndarray  # where each q-gram's postings start
    item: np.ndarray
    place: np.ndarray
    sieve: np.ndarray


def index(rows: list[tuple[int, str | None]], common: set[str], crowded: np.ndarray) -> list[Passages]:
    """Indexes of (item_id, passage) rows, one for each length of q-grams; ``crowded`` ones are left out, and passages that they leave too few go on to shorter ones."""
    groups: dict[int, list] = {}
    for item_id, passage in rows:
        w = words(passage)
        own = _own_words(w, common)
        size = sum(len(x) for x, k in zip(w, own) if k)
        if not size:
            continue
        for q in [x for x in (*GRAMS, 0) if not x or x <= gram_length(size)]:
            codes, at, h, place = _own_grams(w, own, q or GRAMS[-1])
            keep = ~np.isin(h, crowded)
            need = min(bound(size, q), max(LEAST, int(np.ceil(LEAST_PART * keep.sum())))) if q else 0
            if not q or keep.sum() >= max(need, 0.5 * len(h)):
                groups.setdefault(q, []).append((item_id, codes, at, own, w, need, h[keep], place[keep]))
                break
    out = []
    for q, got in groups.items():
        ids, texts, word_at, own, w, need, h, place = map(list, zip(*got))
        item = np.repeat(np.arange(len(ids)), [len(x) for x in h]).astype("i4")
        h, place = np.concatenate(h), np.concatenate(place).astype("i4")
        order = np.argsort(h, kind="stable")
        keys, first = np.unique(h[order], return_index=True)
        sieve = np.zeros(1 << _SIEVE, bool)
        sieve[keys >> np.uint64(_BITS - _SIEVE)] = True
        out.append(Passages(q, ids, texts, word_at, own, w, np.array(need), keys, np.append(first, len(h)).astype("i8"), item[order], place[order], sieve))
    return out


def _traced(table: np.ndarray, item: np.ndarray, padded: np.ndarray, low: int) -> tuple[np.ndarray, tuple[int, int, int, int]]:
    """Matched characters of the passage and the ranges of both sides, walked back from the best cell of a table of diagonals."""
    i, k = (int(x) for x in np.unravel_index(int(table.argmax()), table.shape))
    k, got = k - 1, np.zeros(len(item), bool)
    end_i, end_d = i, i + low + k
    while i > 0 and table[i, k + 1] > 0:
        here = table[i, k + 1]
        same = padded[i - 1 + k] == item[i - 1]
        if here == table[i - 1, k + 1] + (1 if same else -1):
            got[i - 1] = same
            i -= 1
        elif here == table[i - 1, k + 2] - 1:
            i, k = i - 1, k + 1
        else:
            k -= 1
    return got, (i, end_i, i + low + k, end_d)


def aligned(jobs: list[tuple[np.ndarray, np.ndarray, int, int]]) -> list[tuple[np.ndarray, tuple[int, int, int, int]]]:
    """Local alignments of (passage, document, low, high), each within diagonals low..high (document place minus passage place).

    Many are made at once: a row of all their tables is one array.
    """
    out: list = [None] * len(jobs)
    order = sorted(range(len(jobs)), key=lambda j: (jobs[j][3] - jobs[j][2], len(jobs[j][0])))
    for start in range(0, len(order), TOGETHER):
        some = order[start : start + TOGETHER]
        widths = np.array([jobs[j][3] - jobs[j][2] + 1 for j in some])
        deep, width = max(len(jobs[j][0]) for j in some), int(widths.max())
        items, docs = np.full((len(some), deep), 1, "u4"), np.zeros((len(some), deep + width + 1), "u4")
        for r, j in enumerate(some):
            item, doc, low, high = jobs[j]
            items[r, : len(item)] = item
            piece = doc[max(0, low) : max(0, min(len(doc), high + len(item) + 1))]
            docs[r, max(0, -low) : max(0, -low) + len(piece)] = piece[: max(0, docs.shape[1] - max(0, -low))]
        step, inside = np.arange(width, dtype="i2"), (np.arange(width) < widths[:, None]).astype("i2")
        table = np.zeros((deep + 1, len(some), width + 2), "i2")
        for i in range(deep):
            match = (docs[:, i : i + width] == items[:, i, None]).astype("i2") * np.int16(2) - np.int16(1)
            row = np.maximum(np.maximum(table[i, :, 1:-1] + match, table[i, :, 2:] - np.int16(1)), 0) * inside
            table[i + 1, :, 1:-1] = (np.maximum.accumulate(row + step, axis=1) - step) * inside
        for r, j in enumerate(some):
            out[j] = _traced(table[: len(jobs[j][0]) + 1, r], jobs[j][0], docs[r], jobs[j][2])
    return out


def _best_band(diagonal: np.ndarray, place: np.ndarray) -> tuple[int, np.ndarray]:
    """Most distinct passage places in one of the overlapping bands, and which hits are in it."""
    best, which = 0, np.zeros(len(diagonal), bool)
    for shift in (0, BAND // 2):
        band = (diagonal + shift) // BAND
        values, counts = np.unique(np.unique((band << 32) + place) >> 32, return_counts=True)
        if len(counts) and counts.max() > best:
            best, which = int(counts.max()), band == values[counts.argmax()]
    return best, which


def leaked_shares(cases: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], q: int) -> list[float]:
    """Part of a passage's own words that stand in a document in one or two stretches, for each (passage, word of each character, own words, document, places and document places of its q-gram hits)."""

    def job(case: tuple, i0: int, i1: int, d0: int, d1: int) -> tuple | None:
        item, _, _, doc, place, at = case
        inside = (place >= i0) & (place + q <= i1) & (at >= d0) & (at + q <= d1)
        if not inside.any():
            return None
        p, a = place[inside] - i0, at[inside] - d0
        diagonal = (a - p)[_best_band(a - p, p)[1]]
        return item[i0:i1], doc[d0:d1], int(diagonal.min()) - BAND // 2, int(diagonal.max()) + BAND // 2

    def held(case: tuple, got: np.ndarray) -> np.ndarray:
        _, word_at, own = case[:3]
        return own & (np.bincount(word_at, got, len(own)) >= 0.75 * np.bincount(word_at, minlength=len(own)))

    first = aligned([job(c, 0, len(c[0]), 0, len(c[3])) for c in cases])
    boxes, more = [], []
    for n, (c, (_, (s, e, ds, de))) in enumerate(zip(cases, first)):
        for box in ((0, s, 0, ds), (e, len(c[0]), de, len(c[3]))):
            if (j := job(c, *box)) is not None:
                boxes.append((n, box[0]))
                more.append(j)
    best = [held(c, got) for c, (got, _) in zip(cases, first)]
    alone = list(best)
    for (n, i0), (got, _) in zip(boxes, aligned(more)):
        whole = np.zeros(len(cases[n][0]), bool)
        whole[i0 : i0 + len(got)] = got
        both = alone[n] | held(cases[n], whole)
        best[n] = both if both.sum() > best[n].sum() else best[n]
    return [float(b.sum() / c[2].sum()) for b, c in zip(best, cases)]


def _plain_share(words: list[str], own: np.ndarray, text: str) -> float:
    """Most own words that one run of them, or two in order, hold in a squeezed text, as a part of all."""
    at = np.flatnonzero(own)
    # ends[k][j]: where the earliest run of words k..j - 1 ends behind a place; all runs of so few words are tried.
    def runs(start: int, low: int) -> Iterator[tuple[int, int, int]]:
        for k in range(low, len(words)):
            for j in range(k + 1, len(words) + 1):
                found = text.find("".join(words[k:j]), start)
                if found < 0:
                    break
                yield int(((at >= k) & (at < j)).sum()), j, found + len("".join(words[k:j]))

    best = 0
    for n, j, end in runs(0, 0):
        best = max(best, n, *(n + m for m, _, _ in runs(end, j)))
    return best / len(at)


def _find_plain(batch: pd.DataFrame, texts: list[str], passages: Passages) -> list[tuple[int, int, float]]:
    out = []
    for doc, text in zip(batch["doc_id"], texts):
        for i, (item_id, w, own) in enumerate(zip(passages.ids, passages.words, passages.own)):
            if any(x in text for x, k in zip(w, own) if k) and (share := _plain_share(w, own, text)) >= PART:
                out.append((doc, item_id, share))
    return out


def find_in(batch: pd.DataFrame, indexes: list[Passages]) -> list[tuple[int, int, float]]:
    """(doc_id, item_id, share) of the leaked pairs of one batch of documents."""
    texts = [squeeze(t) for t in batch["text"]]
    codes, starts = flatten(texts)
    out = []
    for passages in indexes:
        out += _find_grams(batch, codes, starts, passages) if passages.q else _find_plain(batch, texts, passages)
    return out


def _find_grams(batch: pd.DataFrame, codes: np.ndarray, starts: np.ndarray, passages: Passages) -> list[tuple[int, int, float]]:
    h = grams(codes, passages.q, _BITS)
    maybe = np.flatnonzero(passages.sieve[h >> np.uint64(_BITS - _SIEVE)])
    if not len(maybe) or not len(passages.keys):
        return []
    k = np.searchsorted(passages.keys, h[maybe])
    hit = passages.keys[np.minimum(k, len(passages.keys) - 1)] == h[maybe]
    at, k = maybe[hit], k[hit]
    counts = passages.first[k + 1] - passages.first[k]
    posting = np.repeat(passages.first[k] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    at = np.repeat(at, counts)
    doc = np.searchsorted(starts, at, side="right") - 1
    item, place, at = passages.item[posting].astype("i8"), passages.place[posting].astype("i8"), at - starts[doc]
    order = np.lexsort((at, item, doc))
    doc, item, place, at = doc[order], item[order], place[order], at[order]
    pair = doc * len(passages.ids) + item
    edges = np.flatnonzero(np.diff(pair, prepend=-1, append=-2))
    pairs, cases = [], []
    for a, b in zip(edges[:-1], edges[1:]):
        d, i = int(doc[a]), int(item[a])
        if b - a >= passages.need[i] and _best_band(at[a:b] - place[a:b], place[a:b])[0] >= passages.need[i]:
            pairs.append((d, i))
            cases.append((passages.texts[i], passages.word_at[i], passages.own[i], codes[starts[d] : starts[d + 1] - 1], place[a:b], at[a:b]))
    return [(batch["doc_id"].iat[d], passages.ids[i], share) for (d, i), share in zip(pairs, leaked_shares(cases, passages.q)) if share >= PART]


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, share) of every document that holds a passage; share is that of the passage's own words.

    Null or empty texts and passages hold nothing; passages without own wording never leak; equal passages
    under two ids are both reported.  Passages are taken in blocks of ``BLOCK``, each looked for in one
    pass over all documents without a shuffle.
    """
    wanted = items.select("item_id", "passage").where(F.length("passage") > 0)
    common = common_wording(wanted)
    crowded = crowded_grams(wanted, common)
    blocks = -(-wanted.count() // BLOCK)
    texts = documents.select("doc_id", "text").where(F.length("text") > 0)
    found = None
    for k in range(max(blocks, 1)):
        part = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1))) == k)
        passages = index([(r[0], r[1]) for r in part.orderBy("item_id").collect()], common, crowded)

        def search(batches: Iterator[pd.DataFrame], passages: list[Passages] = passages) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame(find_in(b, passages), columns=["doc_id", "item_id", "share"])

        got = texts.mapInPandas(search, "doc_id bigint, item_id bigint, share double")
        found = got if found is None else found.unionByName(got)
    return found


def share_histogram(found: DataFrame) -> Counter:
    """Leaks by tenth of share, for a look at the margin."""
    return Counter({r[0]: r[1] for r in found.groupBy(F.floor(F.col("share") * 10)).count().collect()})
