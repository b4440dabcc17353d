import random

import numpy as np

from docmill.llm import blocks, linededup

from .helpers import frame, words


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeilnorstu") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    out = [(0, None), (1, ""), (2, "\n\n \n"), (3, "a\na\nA")]
    for i in range(4, n):
        text = []
        for _ in range(rng.randint(1, 8)):
            w = rng.choice(lines).split(" ") if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text.append(" ".join(w) if rng.random() < 0.8 else "  ".join(w).title())
        out.append((i * 2, rng.choice(["\n", "\n\n"]).join(text)))
    rng.shuffle(out)
    return out


def brute(rows, percent=80):
    lines = sorted((i, k, frozenset(words(x))) for i, t in rows for k, x in enumerate((t or "").split("\n")) if words(x))
    like = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
    out = {i: [0, 0, []] for i, _ in rows}
    for at, (i, k, s) in enumerate(lines):
        out[i][0] += 1
        if any(like(s, x) for _, _, x in lines[:at]):
            out[i][1] += 1
            out[i][2].append(k)
    return {i: tuple(v) for i, v in out.items()}


def test_line_dedup(spark):
    for seed, percent in ((1, 80), (2, 60)):
        rows = corpus(seed)
        got = {r.doc_id: (r.n_lines, r.n_removed, r.removed) for r in linededup.line_dedup(frame(spark, rows), percent).collect()}
        assert got == brute(rows, percent)
        assert sum(len(v[2]) for v in got.values()) > 20


def test_few_counters_are_still_exact(spark):
    rows = corpus(3)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.removed) for r in linededup.line_dedup(frame(spark, rows), slot_bits=7).collect()}
    assert got == brute(rows)


def test_hot_tokens_are_dealt_out(spark):
    rows = corpus(4)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.removed) for r in linededup.line_dedup(frame(spark, rows), hot_from=3).collect()}
    assert got == brute(rows)


def test_slices_of_large_groups():
    rng = np.random.default_rng(0)
    n = 50
    cols = {"key": np.full(n, 7, np.uint32), "doc": np.arange(n), "line": np.zeros(n, np.int64), "n": rng.integers(8, 11, n).astype(np.int32), "place": np.zeros(n, np.int32), "role": np.full(n, 7, np.uint8), "s1": np.zeros(n, np.uint64), "s2": np.zeros(n, np.uint64)}
    pairs = lambda size: {(int(a), int(b)) for x, y, _ in linededup.met(cols, 80, size) for a, b in zip(x, y, strict=True)}
    assert pairs(1 << 21) == pairs(7) == pairs(60) and len(pairs(7)) == n * (n - 1) // 2


def test_order_is_total_under_ties():
    h = np.array([1 << 30, (1 << 30) + 1, 5, 5], np.uint64)
    counts = np.ones(1 << linededup.SLOT_BITS, np.uint32)
    a = linededup.sorted_sets(h, np.zeros(4, np.int64), counts)[0]
    b = linededup.sorted_sets(h[::-1], np.zeros(4, np.int64), counts)[0]
    assert a.tolist() == b.tolist() and len(a) == 3


def test_blocks_and_ids_with_several_texts(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(70):  # similar to few of the lines before, so that the likeliest one often fails
        w = list(base)
        for _ in range(rng.randint(2, 5)):
            w[rng.randrange(30)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    for block, kept in ((5, 1), (256, 2), (256, 8)):
        got = {r.doc_id: (r.n_lines, r.n_removed, r.removed) for r in linededup.line_dedup(frame(spark, rows), block=block, kept=kept).collect()}
        assert got == brute(rows)
    rows = [(1, "a b c d e"), (1, "f g h i j"), (1, "f g h i j"), (2, "a b c d e\nf g h i j"), (0, "f g h i j k")]
    got = sorted((r.doc_id, r.n_lines, r.removed, r.tag > 0) for r in linededup.line_dedup(frame(spark, rows)).collect())
    assert got == [(0, 1, [], False), (1, 1, [], True), (1, 1, [0], True), (2, 2, [0, 1], False)]
    lines = {(r.doc_id, r.line, r.first_doc, r.kept) for r in linededup.line_groups(frame(spark, rows)).collect()}
    assert lines == {(0, 0, 0, True), (1, 0, 1, True), (1, 0, 1, False), (2, 0, 1, False), (2, 1, 1, False)}
    assert sorted(r.text for r in linededup.without_lines(frame(spark, rows)).collect()) == ["", "", "", "a b c d e", "f g h i j k"]


def test_likeliest():
    rng = np.random.default_rng(2)
    b, a, far = rng.integers(0, 9, 400), rng.integers(0, 12, 400), None
    far = ((a * 7 + b * 3) % 5).astype(np.float32)
    rows = np.rec.fromarrays([b, b * 0, far, a, a * 0, np.zeros(400, bool)], names="doc_b,line_b,far,doc_a,line_a,more")
    parts = [linededup.likeliest(rows[k : k + 50], 4) for k in range(0, 400, 50)]
    for got in (linededup.likeliest(rows, 4), linededup.likeliest(np.concatenate(parts), 4)):
        for x in range(9):
            want = sorted({(f, y) for f, y, z in zip(far.tolist(), a.tolist(), b.tolist(), strict=True) if z == x})
            mine = got[got["doc_b"] == x]
            assert list(zip(mine["far"].tolist(), mine["doc_a"].tolist(), strict=True)) == want[:4] and set(mine["more"].tolist()) == {len(want) > 4}


def test_forest():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 300, 250), rng.integers(0, 300, 250)
    root = blocks.forest(300, a[100:], b[100:], blocks.forest(300, a[:100], b[:100]))
    group = list(range(300))
    for _ in range(300):
        for x, y in zip(a, b, strict=True):
            group[x] = group[y] = min(group[x], group[y])
    assert root.tolist() == group


def test_texts_without_removed_lines(spark):
    df = frame(spark, [(1, "x y z\nkeep me"), (2, "X  y z\n\nother words"), (3, None), (None, "x y z"), (None, "x y z")])
    out = linededup.without_lines(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, "x y z\nkeep me"), (2, "\nother words"), (3, None), (None, "x y z"), (None, "x y z")], key=repr)
    got = [tuple(r) for r in linededup.line_dedup(df).collect() if r.doc_id is None]
    assert got == [(None, 1, 0, [], 0), (None, 1, 0, [], 0)]


def test_empty_table(spark):
    assert linededup.line_dedup(frame(spark, [])).collect() == []


def test_bitmaps_keep_all_places(spark):
    places = [0, 1, 7, 8, 32767, 32768, 40000, (1 << 20) - 1]
    found = linededup._bitmap(spark.createDataFrame([(x,) for x in places], "s long"), 20)
    assert np.flatnonzero(linededup._has(found, np.arange(1 << 20))).tolist() == places


def test_sparse_counts():
    at, times = np.array([0, 5, (1 << 17) - 1]), np.array([1, 32767, 100_000], np.uint32)
    out = np.zeros(1 << 17, np.uint32)
    linededup._add(out, linededup._sparse(at, times).tobytes())
    linededup._add(out, linededup._sparse(at, times).tobytes())
    assert out[at].tolist() == (2 * times).tolist() and out.sum() == 2 * times.sum()


def test_words_are_told_apart():
    texts = [b"one two  One\n\nthree", None, b"a" * 16 + b" " + b"a" * 17 + b" " + b"A" * 17 + b" " + b"a" * 18, b"x\n" + "é É".encode(), b"a\x00 a"]
    h, line, docs, numbers = linededup.tokens(texts)
    assert (docs.tolist(), numbers.tolist(), line.tolist()) == ([0, 0, 2, 3, 3, 4], [0, 2, 0, 0, 1, 0], [0, 0, 0, 1, 2, 2, 2, 2, 3, 4, 4, 5, 5])
    assert h[0] == h[2] and h[5] == h[6] and len(set(h.tolist())) == 11
