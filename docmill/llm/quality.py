"""Quality by naive Bayes support vectors.

Features are indicators of n-grams: words, and pairs of neighbouring word forms (letter case, digits and punctuation kept,
with a mark where both words are the same), the latter also for shares of the text. Each is scaled by its log-count ratio
between the classes; a linear hinge-loss model is fitted by dual coordinate descent, and its margins become probabilities
on rows it has not seen.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from . import labelled
from .common import Memo
from .svm import dual_coordinate_descent, platt, probability

WORDS, FORMS = 1 << 18, 1 << 17
#: Shares of a document's pairs from which a pair counts as frequent in it.
SHARES = (0.02, 0.08, 0.3)
#: Labelled rows of either class that the model is fitted on, at most.
SAMPLE = 8_000
COST = 0.5
_MIX = np.uint64(0x9E3779B97F4A7C15)


def form(word: str) -> str:
    """Runs of letters as their case and runs of digits as one sign each; other characters as they are, at most four."""
    s = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "C" if m[0][0].isupper() else "a", word)
    s = re.sub(r"\d+", "0", s)
    return s[:8] + s[-4:] if len(s) > 12 else s


class Features:
    def __init__(self, bound: int = 150_000) -> None:
        import xxhash

        code = xxhash.xxh3_64_intdigest
        self.known = Memo(lambda w: code(w.lower().encode("utf-8", "surrogatepass")) % WORDS | (code(form(w).encode("utf-8", "surrogatepass")) % (1 << 20) + 1) << 20, bound)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct word features (below WORDS) and form features (from WORDS)."""
        words = text.split()
        got = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        unigrams = np.unique(got & (WORDS - 1))
        forms = np.concatenate([[0], got >> 20, [0]]).astype(np.uint64)
        same = np.zeros(len(forms) - 1, np.uint64)
        same[1:-1] = got[1:] == got[:-1]
        pair = (forms[:-1] * _MIX + forms[1:]) * np.uint64(2) + same
        pair, times = np.unique(pair, return_counts=True)
        share = times / (len(words) + 1)
        all_ = [pair * np.uint64(4)] + [pair[(share >= s) & (times > 2)] * np.uint64(4) + np.uint64(i + 1) for i, s in enumerate(SHARES)]
        mixed = np.concatenate(all_) * _MIX
        return unigrams, WORDS + np.unique(((mixed >> np.uint64(40)) % np.uint64(FORMS)).astype(np.int64))


def log_count_ratios(found: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n: int) -> np.ndarray:
    """Of n features: how much likelier a document of class 1 has each, from counts of documents with one added."""
    p, q = np.ones(n), np.ones(n)
    for (a, b), one in zip(found, y, strict=True):
        side = p if one else q
        side[a] += 1
        side[b] += 1
    return np.log(p / (y.sum() + 2)) - np.log(q / ((~y).sum() + 2))


def fit(texts: list[str], labels: list[int], cost: float = COST) -> dict:
    features = Features()
    found = [features(t) for t in texts]
    y = np.array(labels) == 1
    n = WORDS + FORMS
    test = np.arange(len(y)) % 5 == 4
    learn = np.flatnonzero(~test)  # the rest is for probabilities alone, counts included
    ratio = log_count_ratios([found[k] for k in learn], y[learn], n)

    def row(a, b):
        i = np.concatenate([a, b])
        scale = np.concatenate([np.full(len(a), 0.5 / np.sqrt(max(len(a), 1))), np.full(len(b), 1 / np.sqrt(max(len(b), 1)))])
        return i, ratio[i] * scale

    rows = [row(a, b) for a, b in found]
    sign = np.where(y, 1.0, -1.0)
    balance = np.where(y, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((~y).sum(), 1))) * cost
    w = dual_coordinate_descent([rows[i] for i in learn], sign[learn], n, balance[learn])
    margins = np.array([w[rows[i][0]] @ rows[i][1] + w[n] for i in np.flatnonzero(test)])
    a, b = platt(margins, y[test])
    return {"weights": (w[:n] * ratio).astype(np.float32), "bias": float(w[n]), "platt": (a, b)}


def scorer(model: dict):
    features, w = Features(), model["weights"]

    def score(texts):
        margins = np.empty(len(texts))
        for k, t in enumerate(texts):
            a, b = features(t)
            margins[k] = 0.5 * w[a].sum() / np.sqrt(max(len(a), 1)) + w[b].sum() / np.sqrt(len(b)) + model["bias"]
        return probability(margins, *model["platt"])

    return score


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, label: str = "quality", each: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that quality() predicts 1 for, with all their columns; without labelled rows all stay."""
    model = labelled.fitted(labelled.sample(docs, labels, label, each, id_col, text_col), fit)
    return docs if model is None else labelled.kept(docs, model, scorer, lambda x: x >= threshold, text_col)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, label: str = "quality", each: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score (higher: label 1 likelier) and predicted (score >= threshold).

    Fitted on at most `each` labelled rows of either class that are not held out; scores whole texts and nothing else.
    Null texts count as empty; null ids stay null and are never learned from; without labelled rows every score is 0.5;
    rows are scored one by one, so repeated rows have equal scores and an empty table gives an empty result."""
    model = labelled.fitted(labelled.sample(docs, labels, label, each, id_col, text_col), fit)
    return labelled.scores(docs, model, scorer, threshold, id_col, text_col)
