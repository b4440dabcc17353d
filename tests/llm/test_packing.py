import zlib

import numpy as np
import pytest

from docmill.llm import packing

from .helpers import corpus, frame


def held(groups, capacity):
    out = {}
    for g in groups:
        assert g.left >= 0 and sum(n * k for n, k in g.runs) + g.left == capacity
        for n, k in g.runs:
            out[n] = out.get(n, 0) + k * g.count
    return out


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_the_histogram(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5.5, 0.3 + seed / 5, 4000).astype(int), 1, 4096)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    groups = packing.plan(dict(histogram))
    assert held(groups, 4096) == histogram
    assert sum(g.count for g in groups) <= 1.02 * -(-lengths.sum() // 4096) + 1


@pytest.mark.parametrize("histogram", [{}, {4096: 3}, {1: 10_000}, {2049: 5, 2047: 5}, {5: 1}])
def test_plan_of_few_lengths(histogram):
    groups = packing.plan(dict(histogram))
    assert held(groups, 4096) == histogram
    assert sum(g.count for g in groups) == -(-sum(n * c for n, c in histogram.items()) // 4096)


def test_nnls_matches_known_solutions():
    a = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])
    assert np.allclose(packing.nnls(a, np.array([1.0, 2.0, 3.0])), [1, 2])
    assert np.allclose(packing.nnls(a, np.array([-1.0, 2.0, 1.0])), [0, 1.5])


@pytest.mark.parametrize("bits", [4, 20])
def test_word_table_equals_the_library(bits):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("word_bpe_49k.json")
    texts = [t or "" for _, t in corpus()] + ["<|endoftext|>a <|startoftext|>", "\x01 mark \x01", "it's  WE'LL　x y", "é İΣ Σ"]
    texts += ["a\x00", "a", "x" * 15, "x" * 16, "x" * 14 + "\x00", "fifteen bytes..", " \n ", "no end", "\x00" * 3, "\x00"]
    table = packing.WordTable(path, bits)
    data = [t.encode() for t in texts]
    table(data[::-1])
    got = [x for a, b in packing.slices(data, 2000) for x in table(data[a:b])]
    assert table([]) == []
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in want]


def test_pack(spark):
    rows = [*corpus(), (None, "null id"), (6, "again"), (6, "again")]
    got = packing.pack(frame(spark, rows)).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json"))
    want = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4").tobytes()
            want.append((i if i is not None else -1, k // 4096, k, len(part) // 4, zlib.crc32(part), part))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(x[3] for x in want) // 4096) + 1


def test_hot_lengths_are_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 7)
    pieces = spark.range(1000).selectExpr("id AS doc_id", "0 AS piece", "CASE WHEN id % 3 = 0 THEN 100L ELSE id + 1 END AS length")
    got = packing.place(pieces).collect()
    assert len(got) == 1000 and len({(r.sequence_id, r.offset) for r in got}) == 1000


def test_empty_table(spark):
    assert packing.pack(frame(spark, [])).collect() == []
