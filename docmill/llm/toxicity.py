"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine over labelled sentences.

Units are words without punctuation, and runs of single characters joined. Two units are compared by the gap-weighted
kernel of their common subsequences of ORDER characters, normalised, so inserted or spread characters lower it little.
A sentence is compared with a landmark by its most similar unit; the similarities to all landmarks, times the inverse root
of the landmarks' own kernel matrix, are its features. A landmark is looked at only where a unit has all of its
characters, or all but one of five or more. The machine learns from sentences' similarities of at least FLOOR, and
from all similarities of those single units of clean texts that come inside its margin. What it has learned is applied to
sentences and to every single unit with all its similarities, however low. A document has the highest of these margins.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from . import labelled
from .common import Memo
from .svm import dual_coordinate_descent, platt, probability

ORDER, DECAY = 3, 0.65
#: Lower similarities are left out of a sentence's; they count for single units.
FLOOR = 0.35
#: Longest part of a unit that is compared at once; longer units are taken in overlapping parts.
WIDTH = 24
#: Lengths of beginnings of units that can be landmarks too, so words with other endings are found.
STEMS = (4, 5, 6)
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 160, 32
#: Log-likelihood ratio from which a unit of toxic sentences can be a landmark.
EVIDENCE = 12.0
#: Labelled rows of either class that the model is fitted on, at most.
SAMPLE = 4_000
#: Where a sentence ends: after a word that ends so, as ends_sentence() has it.
SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: What is known of words that are like no landmark.
NONE = ()
_PUNCTUATION = re.compile(r"[\W_]+")


def plain(word: str) -> str:
    return _PUNCTUATION.sub("", word.lower())


def parts(unit: str) -> list[str]:
    return [unit] if len(unit) <= WIDTH else [unit[i : i + WIDTH] for i in range(0, len(unit) - WIDTH // 2, WIDTH // 2)]


def coded(units: list[str]) -> np.ndarray:
    """Code points in rows of equal length; 0 fills."""
    width = max(map(len, units), default=1) or 1
    data = np.frombuffer("".join(u.ljust(width, "\0") for u in units).encode("utf-32-le", "surrogatepass"), np.uint32)
    return data.reshape(len(units), width)


def kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of row i of s and row i of t: every common subsequence of `order` characters adds
    decay to the power of the lengths it spans in both."""
    out = np.empty(len(s))
    by_length = np.argsort((s != 0).sum(axis=1), kind="stable")
    for at in range(0, len(s), 512):  # small enough to stay in a core's cache
        rows = by_length[at : at + 512]
        a, b = s[rows], t[rows]
        a, b = a[:, : max(1, int((a != 0).sum(axis=1).max()))], b[:, : max(1, int((b != 0).sum(axis=1).max()))]
        same = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] != 0)) * np.float32(decay**2)
        m = same
        for _ in range(order - 1):
            # sum over earlier pairs, decayed by how far back they are
            d = np.zeros_like(m)
            d[:, 1:, 1:] = m[:, :-1, :-1]
            for j in range(2, d.shape[1]):
                d[:, j] += np.float32(decay) * d[:, j - 1]
            for k in range(2, d.shape[2]):
                d[:, :, k] += np.float32(decay) * d[:, :, k - 1]
            m = same * d
        out[rows] = m.sum(axis=(1, 2))
    return out


def self_kernel(units: list[str]) -> np.ndarray:
    c = coded(units)
    return kernel(c, c)


class Similarity:
    """Similarities of units to the landmarks, None for a unit that is like none of them; with a direction also margins of single units."""

    def __init__(self, landmarks: list[str], direction: np.ndarray | None = None, bound: int = 120_000) -> None:
        self.direction = direction
        self.landmarks, self.codes = landmarks, coded(landmarks)
        self.own = np.sqrt(self_kernel(landmarks))
        letters = sorted(set("".join(landmarks)))
        self.bit = np.zeros(1 << 16, np.uint64)
        for i, x in enumerate(letters):
            self.bit[min(ord(x), 0xFFFF)] = np.uint64(1 << (i % 64))
        self.mask = np.array([self._mask(x) for x in landmarks], np.uint64)
        distinct = np.bitwise_count(self.mask).astype(np.int64)
        self.need = distinct - (distinct > 4)
        self.known = Memo(None, bound)

    def _mask(self, unit: str) -> int:
        out = 0
        for x in unit:
            out |= int(self.bit[min(ord(x), 0xFFFF)])
        return out

    def of(self, units: list[str]) -> list[np.ndarray | None]:
        """units: of one part each."""
        out: list = [None] * len(units)
        codes = coded(units)
        masks = np.bitwise_or.reduce(self.bit[np.minimum(codes, 0xFFFF)], axis=1)
        shared = np.bitwise_count(masks[:, None] & self.mask[None, :]) >= self.need[None, :]
        shared &= (np.array([len(u) for u in units]) >= ORDER)[:, None]
        i, j = np.nonzero(shared)
        if not len(i):
            return out
        who, back = np.unique(i, return_inverse=True)
        own = np.sqrt(kernel(codes[who], codes[who]))
        k = kernel(codes[i], self.codes[j]) / (own[back] * self.own[j])
        rows = np.zeros((len(who), len(self.landmarks)))
        rows[back, j] = k
        for x in np.flatnonzero(rows.any(axis=1)):
            out[int(who[x])] = rows[x]
        return out

    def learn(self, words: list[str]) -> None:
        """Make known of raw words: similarities of at least FLOOR, or None; the margin of all similarities."""
        units, of = [], []
        for w in words:
            for p in parts(plain(w)):
                units.append(p)
                of.append(w)
        found = dict.fromkeys(words, NONE)
        for at in range(0, len(units), 20_000):
            for w, k in zip(of[at : at + 20_000], self.of(units[at : at + 20_000]), strict=True):
                if k is not None:
                    high = np.where(k >= FLOOR, k, 0.0) if k.max() >= FLOOR else None
                    alone = 0.0 if self.direction is None else float(self.direction @ k)
                    if found[w] is not NONE:
                        before, other = found[w]
                        high, alone = before if high is None else high if before is None else np.maximum(before, high), max(alone, other)
                    if high is not None or alone > 0:
                        found[w] = (high, alone)
        for w, k in found.items():
            self.known.put(w, k)

    def sentences(self, texts: list[str]) -> list[list[np.ndarray]]:
        """Of each text: similarities from FLOOR of those sentences that are like some landmark."""
        return [x for x, _ in self.looked_up(texts)]

    def margins(self, texts: list[str]) -> np.ndarray:
        """Of each text: the highest margin of a sentence or of a single unit, 0 at least."""
        return np.array([max([0.0, alone, *(float(self.direction @ x) for x in found)]) for found, alone in self.looked_up(texts)])

    def looked_up(self, texts: list[str]) -> list[tuple[list[np.ndarray], float]]:
        """sentences() of each text, and the highest margin of a single unit."""
        split, new = [], {}
        known = self.known
        if len(known) > known.bound:
            known.old = dict(known)
            known.clear()
        for t in texts:
            words = t.split()
            sizes = list(map(len, words))
            spelled = []
            if sizes.count(1) >= ORDER:
                spelled = spelled_out(words, [i for i, n in enumerate(sizes) if n == 1])
            split.append((words, spelled))
            for w in words:
                if w not in known:
                    new[w] = None
            for _, w in spelled:
                if w not in known:
                    new[w] = None
        ask = []
        for w in new:
            got = known.old.pop(w, None)
            if got is None:
                ask.append(w)
            else:
                known[w] = got
        bound, known.bound = known.bound, len(known) + len(ask) + known.bound  # none of these may go before it is read
        self.learn(ask)
        known.bound = bound
        out = []
        for t, (words, spelled) in zip(texts, split, strict=True):
            got = list(map(known.__getitem__, words))
            like = [(i, k) for i, k in enumerate(got) if k is not NONE]
            like += [(i, known[w]) for i, w in spelled if known[w] is not NONE]
            if not like:
                out.append(([], 0.0))
                continue
            alone = max(k[1] for _, k in like)
            like = [(i, k[0]) for i, k in like if k[0] is not None]
            found: dict[int, np.ndarray] = {}
            ends = np.cumsum([ends_sentence(w) for w in words]) if like else ()
            for i, k in like:
                s = int(ends[i - 1]) if i else 0
                found[s] = np.maximum(found[s], k) if s in found else k
            out.append((list(found.values()), alone))
        return out


def spelled_out(words: list[str], ones: list[int]) -> list[tuple[int, str]]:
    """(index of the first, joined) of runs of single characters, in parts of WIDTH."""
    out, run = [], [ones[0]]
    for i in [*ones[1:], -1]:
        if i == run[-1] + 1:
            run.append(i)
            continue
        if len(run) >= ORDER:
            text = "".join(words[j] for j in run)
            out += [(run[0], p) for p in parts(text)]
        run = [i]
    return out


def ends_sentence(word: str) -> bool:
    return word[-1] in ".!?"


def fit(texts: list[str], labels: list[int]) -> dict | None:
    y = np.array(labels) == 1
    if not y.any() or y.all():
        return None
    test = np.arange(len(y)) % 5 == 4  # for probabilities alone; counts and landmarks come from the others
    # By different sentences: what copies of a document repeat is no evidence.
    counts, seen = (Counter(), Counter()), (set(), set())
    for t, one in ((texts[k], y[k]) for k in np.flatnonzero(~test)):
        for s in SENTENCE.split(t):
            if s not in seen[int(one)]:
                seen[int(one)].add(s)
                units = {u for w in set(s.split()) if len(u := plain(w)) >= ORDER and len(u) <= WIDTH}
                counts[int(one)].update(units.union(*[{u[:k] for u in units if len(u) > k} for k in STEMS]))
    n1, n0 = len(seen[1]), len(seen[0])
    if not n1 or not n0:
        return None
    least = 4

    def gain(u):
        """Log-likelihood ratio of what a unit says about the class, for those of the toxic one."""
        a, b = counts[1][u] / n1, counts[0][u] / n0
        if a <= 2 * b:
            return 0.0
        m = (counts[1][u] + counts[0][u]) / (n1 + n0)
        part = lambda x, p, q: x * np.log(max(p, 1e-12) / q) + (1 - x) * np.log(max(1 - p, 1e-12) / max(1 - q, 1e-12))
        return n1 * part(a, a, m) + n0 * part(b, b, m)

    ranked = sorted(((gain(u), len(u), u) for u, c in counts[1].items() if c >= least), reverse=True)
    landmarks: list[str] = []
    for g, _, u in ranked:
        if g < EVIDENCE or len(landmarks) == TOXIC_LANDMARKS:
            break
        # A stem that says no more than a longer unit is left out.
        if not any((v.startswith(u) or u.startswith(v)) and abs(counts[1][u] - counts[1][v]) <= 0.05 * counts[1][v] for v in landmarks):
            landmarks.append(u)
    toxic = len(landmarks)
    if not landmarks:
        return None
    # Clean units most like those, where the border between the classes lies.
    rough = Similarity(landmarks)
    clean = [u for u in counts[0] if u not in counts[1] or counts[0][u] / n0 >= counts[1][u] / n1]
    near = []
    for at in range(0, len(clean), 20_000):
        some = clean[at : at + 20_000]
        near += [(float(k.max()), u) for u, k in zip(some, rough.of(some), strict=True) if k is not None and k.max() >= FLOOR]
    landmarks += [u for _, u in sorted(near, reverse=True)[:CLEAN_LANDMARKS]]
    similar = Similarity(landmarks)
    m = len(landmarks)
    i, j = np.divmod(np.arange(m * m), m)
    own = kernel(similar.codes[i], similar.codes[j]).reshape(m, m) / np.outer(similar.own, similar.own)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.05))) @ vectors.T
    found = []
    for at in range(0, len(texts), 256):
        found += similar.sentences(texts[at : at + 256])
    # Sentences: of a toxic text the one most like a toxic landmark, of a clean text all that are like any, and a bare one.
    rows, sign = [np.zeros(m)], [-1.0]
    for k in np.flatnonzero(~test):
        if y[k]:
            if found[k]:
                rows.append(max(found[k], key=lambda x: x[:toxic].max()))
                sign.append(1.0)
        else:
            rows += found[k]
            sign += [-1.0] * len(found[k])
    sign = np.array(sign)
    ones = max((sign > 0).sum(), 1)
    cost = np.where(sign > 0, len(sign) / (2 * ones), len(sign) / (2 * max(len(sign) - ones, 1)))
    cost[0] = len(sign)
    every = np.arange(m)
    rows = [(every, root @ r) for r in rows]
    w = dual_coordinate_descent(rows, sign, m, cost)
    # Single units of clean texts, with all their similarities, that come inside the margin: learned from in a second turn.
    units = sorted({p for k in np.flatnonzero(~test & ~y) for x in set(texts[k].split()) for p in parts(plain(x)) if len(p) >= ORDER})
    hard = []
    for at in range(0, len(units), 20_000):
        some = np.array([root @ k for k in similar.of(units[at : at + 20_000]) if k is not None]).reshape(-1, m)
        hard += [(every, r) for r in some[some @ w[:m] + w[m] > -1]]
    w = dual_coordinate_descent(rows + hard, np.r_[sign, -np.ones(len(hard))], m, np.r_[cost, np.ones(len(hard))])
    direction, bias = root @ w[:m], float(w[m])
    scored, tests = Similarity(landmarks, direction), [texts[k] for k in np.flatnonzero(test)]
    margins = np.concatenate([scored.margins(tests[at : at + 256]) for at in range(0, max(len(tests), 1), 256)]) + bias
    return {"landmarks": landmarks, "direction": direction, "bias": bias, "platt": platt(margins, y[test])}


def scorer(model: dict):
    similar = Similarity(model["landmarks"], model["direction"])

    def score(texts):
        return probability(similar.margins(texts) + model["bias"], *model["platt"])

    return score


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label: str = "toxic", each: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that toxicity() predicts 0 for, with all their columns; where the labels lack a class all stay."""
    model = labelled.fitted(labelled.sample(docs, labels, label, each, id_col, text_col), fit)
    return docs if model is None else labelled.kept(docs, model, scorer, lambda x: x < threshold, text_col)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label: str = "toxic", each: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score (higher: label 1 likelier) and predicted (score >= threshold).

    Fitted on at most `each` labelled rows of either class that are not held out; scores whole texts and nothing else.
    Null texts count as empty and have no toxic sentence; null ids stay null and are never learned from; where the labelled
    rows lack a class every score is 0.5; repeated rows have equal scores and an empty table gives an empty result."""
    model = labelled.fitted(labelled.sample(docs, labels, label, each, id_col, text_col), fit)
    return labelled.scores(docs, model, scorer, threshold, id_col, text_col)
