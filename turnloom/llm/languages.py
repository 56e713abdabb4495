"""Language of short texts: naive Bayes over hashed character n-grams, fitted on a bounded labelled sample."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np

from turnloom.llm.ngrams import flatten, grams

BITS = 16
ORDERS = (3, 4)
#: Bucket of what is no n-gram; it weighs nothing.
NOTHING = len(ORDERS) << BITS
#: Texts whose n-grams are held at once.
CHUNK = 1000
#: A capitalised word tells a language from so many occurrences in the sample, with such a share in one language.
CAPITAL_COUNT, CAPITAL_SHARE = 12, 0.9
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_CAPITALISED = re.compile(r"\b[^\W\d_a-zа-я]+[^\W\d_A-ZА-Я]+\w*")


def letters(text: str | None, telling: frozenset[str] = frozenset()) -> str:
    """Lower-case letters with single blanks between and around words; '' for null.

    Capitalised words are left out as names unless they are among ``telling``.
    """
    if not text:
        return ""
    bare = _CAPITALISED.sub(lambda m: m[0] if m[0] in telling else " ", text)
    words = _NOT_LETTERS.sub(" ", bare.lower()).strip()
    return f" {words} " if words else ""


def telling_capitals(texts: list[str], labels: list[str]) -> frozenset[str]:
    """Capitalised words that occur often and nearly always in one language (so no names)."""
    counts: dict[str, Counter] = {}
    for text, label in zip(texts, labels):
        for w in set(_CAPITALISED.findall(text)):
            counts.setdefault(w, Counter())[label] += 1
    return frozenset(w for w, c in counts.items() if c.total() >= CAPITAL_COUNT and max(c.values()) >= CAPITAL_SHARE * c.total())


def _features(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the bucket of the n-gram at each character (``NOTHING`` across texts), and where each text starts."""
    codes, starts = flatten(texts)
    blank, out = codes == 0, []
    for k, n in enumerate(ORDERS):
        h = np.full(len(codes), NOTHING, "i8")
        got = grams(codes, n, BITS).astype("i8") + (k << BITS)
        across = blank[: len(got)].copy()
        for j in range(1, n):
            across |= blank[j : len(got) + j]
        got[across] = NOTHING
        h[: len(got)] = got
        out.append(h)
    return out, starts


@dataclass(frozen=True)
class LanguageModel:
    """Log weights of each bucket for each language; its size is fixed whatever it is fitted on."""

    languages: tuple[str, ...]
    weights: np.ndarray
    telling: frozenset[str] = frozenset()

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log likelihood of each text in each language, up to a constant of the text; 0 for texts without letters."""
        out = np.zeros((len(texts), len(self.languages)))
        for start in range(0, len(texts), CHUNK):
            features, at = _features([letters(t, self.telling) for t in texts[start : start + CHUNK]])
            sums = self.weights[features[0]]
            for h in features[1:]:
                sums = sums + self.weights[h]
            out[start : start + CHUNK] = np.add.reduceat(sums, at[:-1])
        return out


def fit(texts: list[str], labels: list[str], rounds: int = 2) -> LanguageModel:
    """Fit on labelled texts; after each round but the last, rows that the model places clearly elsewhere are left out."""
    known = tuple(sorted(set(labels)))
    y = np.array([known.index(x) for x in labels])
    kept = np.ones(len(texts), bool)
    telling = telling_capitals(texts, labels)
    size = NOTHING + 1
    for _ in range(rounds):
        counts = np.zeros((size, len(known)), "f8")
        for start in range(0, len(texts), CHUNK):
            features, at = _features([letters(t, telling) for t in texts[start : start + CHUNK]])
            owner = np.repeat(np.arange(len(at) - 1), np.diff(at)) + start
            for h in features:
                own = h[at[0] : at[-1]]
                for k in range(len(known)):
                    counts[:, k] += np.bincount(own[((y == k) & kept)[owner]], minlength=size)
        counts[NOTHING] = 0
        share = (counts + 0.25) / (counts.sum(0) + 0.25 * size)
        weights = (np.log(share) - np.log(share.mean(1, keepdims=True))).astype("f4")
        weights[NOTHING] = 0
        model = LanguageModel(known, weights, telling)
        s = model.scores(texts)
        kept = s.max(1) - s[np.arange(len(y)), y] < 5
    return model
