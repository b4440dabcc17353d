import numpy as np
import pytest

from docmill.llm import components, neardup

from .helpers import corpus, frame, shingles


def brute(rows, k):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted((i, len(s), root(i), i == root(i)) for i, s in sets)


@pytest.mark.parametrize(("width", "block"), [(4, 384), (5, 384), (4, 5)])
def test_near_groups(spark, width, block):
    rows = corpus(seed=width)
    got = sorted(tuple(r) for r in neardup.near_groups(frame(spark, rows), width, block=block).collect())
    assert got == brute(rows, width)


def test_links_do_not_depend_on_the_size_of_a_cluster(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(w if k != 3 + i * 6 else f"new{i}" for k, w in enumerate(base))) for i in range(24)]
    rows += [(100 + i, " ".join(f"v{x}" for x in rng.integers(0, 500, 40))) for i in range(6)]
    # So few half keys find candidates, but two linked members have fewer equal ones than splitting large clusters asked for.
    whole, split = (sorted(tuple(r) for r in neardup.near_groups(frame(spark, rows), 4, halves=1, rows=1, block=b).collect()) for b in (384, 5))
    assert whole == split and sum(not r[3] for r in whole) > 5


def test_links_of_blocks_equal_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1000, 60)
    sets = [np.unique(np.r_[base[rng.random(60) < 0.9], rng.integers(0, 1000, 3)]).astype(np.uint64) for _ in range(40)]
    for blocks in ([0] * 40, [i % 2 for i in range(40)]):
        found = neardup.links(sets, blocks, 80)
        want = [(i, j) for i in range(40) for j in range(i + 1, 40) if (blocks[i] != blocks[j] or len(set(blocks)) == 1) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        group = lambda pairs: {frozenset(c) for c in _components(pairs)}
        assert group(found) == group(want) and len(found) < 40


def _components(pairs):
    out = []
    for a, b in pairs:
        hit = [c for c in out if a in c or b in c]
        out = [c for c in out if c not in hit] + [set().union({a, b}, *hit)]
    return out


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).selectExpr("id AS u", "id + 1 AS v").unionAll(spark.range(100, 103).selectExpr("id AS u", "200L AS v")).unionAll(spark.sql("SELECT 5L AS u, 5L AS v UNION ALL SELECT NULL, 3"))
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100, 200: 100}


def test_null_ids_and_repeated_rows(spark):
    text = "a b c d e f g h"
    got = [tuple(r) for r in neardup.near_groups(frame(spark, [(None, text), (4, text), (2, text), (2, text), (7, None)]), 4).collect()]
    assert sorted(got, key=repr) == sorted([(None, 5, None, True), (4, 5, 2, False), (2, 5, 2, True), (2, 5, 2, True), (7, 0, 7, True)], key=repr)


def test_ids_with_several_texts(spark):
    a, b, c = "a b c d e f g h", "i j k l m n o p q r s t u v w x y z", "1 2 3 4 5 6 7 8"
    rows = [(5, a), (5, b), (3, b), (9, a), (8, c), (8, c), (4, b + " zz"), (6, "x"), (6, None)]
    got = sorted(tuple(r)[::2] for r in neardup.near_groups(frame(spark, rows), 4).collect())
    assert got == [(3, 3), (4, 3), (5, 3), (5, 3), (6, 6), (6, 6), (8, 8), (8, 8), (9, 3)]
    assert sorted(r.doc_id for r in neardup.drop_near_copies(frame(spark, rows), 4).collect()) == [3, 6, 6, 8, 8]


def test_drop_near_copies(spark):
    df = frame(spark, corpus(seed=4))
    out = neardup.drop_near_copies(df, width=4)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [i for i, _, _, kept in brute(corpus(seed=4), 4) if kept]


def test_empty_table(spark):
    assert neardup.near_groups(frame(spark, [])).collect() == []
