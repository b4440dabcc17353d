import math
import zlib
from collections import Counter, defaultdict

import pytest

from docmill.llm import ppm

from .helpers import corpus, frame, words


def brute(rows):
    trained = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0
    counts, nodes = Counter(), [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    symbols = lambda t: [ppm.END] * ppm.ORDER + list((t or "").encode()) + [ppm.END]
    for i, t in rows:
        if trained(i):
            counts.update([*words(t), None])
            s = symbols(t)
            for k in range(ppm.ORDER, len(s)):
                for o in range(ppm.ORDER + 1):
                    nodes[o][tuple(s[k - o : k])][s[k]] += 1
    n, v = sum(counts.values()), len(counts)

    def probability(context, s):
        out, seen = 0.0, set()
        for o in range(ppm.ORDER, -1, -1):
            left = {x: c for x, c in nodes[o].get(context[ppm.ORDER - o :], {}).items() if x not in seen}
            if left:
                total = sum(left.values()) + len(left)
                if s in left:
                    return out + math.log10(left[s] / total)
                out += math.log10(len(left) / total)
                seen |= left.keys()
        return out - math.log10(257 - len(seen))

    out = []
    for i, t in rows:
        w = [*words(t), None]
        s = symbols(t)
        out.append((i, not trained(i), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), sum(probability(tuple(s[k - ppm.ORDER : k]), s[k]) for k in range(ppm.ORDER, len(s)))))
    return out


@pytest.mark.parametrize(("chunk", "fan"), [(16 << 20, 256), (3000, 256), (900, 3)])
def test_scores_equal_brute_force(spark, chunk, fan):
    rows = [*corpus(n=60)[:55], (None, "null id"), (3, "again"), (3, "again")]
    got = sorted((tuple(r) for r in ppm.score(frame(spark, rows), chunk_bytes=chunk, fan=fan).collect()), key=repr)
    want = sorted(brute(rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], abs=1e-6) and g[6] == pytest.approx(w[6], rel=1e-5, abs=1e-3)


def test_probabilities_sum_to_one():
    import numpy as np

    keys, counts = ppm.gram_counts([b"abracadabra", b"abcab"], [True, True])
    pair = keys & ((1 << 2 * ppm.BITS) - 1)
    cells = np.zeros((ppm.END + 1, 2 * ppm.END), np.int64)
    np.add.at(cells, (pair >> ppm.BITS, pair & (2 * ppm.END - 1)), counts)
    for context in (b"cadab", b"zzzab", b"zzzzz"):
        base = 0
        for c in context:
            base = base << ppm.BITS | c
        asked = np.array([base << ppm.BITS | s for s in range(257)])
        every, sums = ppm.counted(np.r_[keys, asked], np.r_[counts, np.zeros(257, np.int64)])
        p = ppm.code_lengths(every, sums, cells)
        assert sum(10 ** p[np.searchsorted(every, asked)]) == pytest.approx(1)


def test_empty_table_and_no_training_rows(spark):
    assert ppm.score(frame(spark, [])).collect() == []
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = ppm.score(frame(spark, [(held, "ab c")])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)
    assert r.score == pytest.approx(-5 * math.log10(257), rel=1e-6)


def test_held_out_rows_are_compressed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.score for r in ppm.score(docs).where("held_out").collect()}
    size = sum(len(r.text.encode()) for r in docs.collect() if r.doc_id in got)
    assert -sum(got.values()) / math.log10(2) / size < 2.6  # bits a byte
