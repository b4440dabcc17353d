import hashlib

from pyspark.sql import functions as F

from docmill.llm import common, dedup

from .helpers import corpus, frame, normalised


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normalised(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[normalised(t)]
        keep = min((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256(normalised(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_exact_groups(spark):
    rows = [*corpus(), (None, "one"), (None, "only null"), (9, "twice"), (9, "twice")]
    assert got(dedup.exact_groups(frame(spark, rows))) == brute(rows)


def test_digest_clashes_are_told_apart_by_bytes(spark):
    rows = corpus()
    weak = lambda t: F.unhex(F.substring(F.sha2(F.encode(t, "UTF-8"), 256), 1, 2))
    found = dedup.exact_groups(frame(spark, rows), digest=weak).collect()
    assert sorted(tuple(r)[:4] for r in found) == sorted(r[:4] for r in brute(rows))


def test_index_compacts_levels(spark):
    index = dedup.DigestIndex(spark, fanout=2)
    for k in range(5):
        rows = spark.range(k, k + 4).select(F.unhex(F.sha2((F.col("id") % 3).cast("string"), 256)).alias("digest"), F.col("id"))
        index.flush(rows)
    assert set(index.runs) == {0, 2}
    top = {(r.id, r.rows) for r in index.compact().collect()}
    ids = [i for k in range(5) for i in range(k, k + 4)]
    assert top == {(min(i for i in ids if i % 3 == m), sum(i % 3 == m for i in ids)) for m in range(3)}


def test_a_table_is_flushed_as_several_runs(spark):
    rows = spark.range(0, 300, 1, 9).select(F.unhex(F.sha2((F.col("id") % 40).cast("string"), 256)).alias("digest"), F.col("id"))
    index = dedup.DigestIndex(spark, fanout=4)
    assert index.flush(rows, 6).count() == 300 and {k: len(v) for k, v in index.runs.items()} == {1: 2}
    later = spark.range(30, 60).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.col("id"))
    assert sorted(r.id for r in index.lookup(later).collect()) == list(range(30, 40))
    index.flush(later)
    assert {(r.id, r.rows) for r in index.compact().collect()} == {(i, 300 // 40 + (i < 20) + (i >= 30)) for i in range(40)} | {(i, 1) for i in range(40, 60)}


def test_filters_lose_nothing(spark):
    values = common.written(spark.range(0, 60_000, 7).selectExpr("id * 3 AS v"), "values")
    rows = spark.range(180_000).selectExpr("id", "id AS v", "'x' AS text").unionByName(spark.sql("SELECT NULL AS id, NULL AS v, 'x' AS text"))
    found = common.likely_among(rows, F.col("id"), values)
    assert found.columns == rows.columns and found.join(values, "v", "left_semi").count() == values.count()
    assert found.count() < values.count() + 20_000
    assert common.marked(rows, F.col("id"), values.limit(0), "m").where("NOT m").count() == 180_001


def test_drop_copies_keeps_columns(spark):
    df = frame(spark, corpus())
    out = dedup.drop_copies(df)
    assert out.columns == df.columns and out.count() == len({normalised(t) for _, t in corpus()})


def test_drop_copies_keeps_one_row_of_each_text(spark):
    rows = [(5, "A"), (3, "B"), (5, "B"), (9, "twice"), (9, "twice"), (None, "B"), (None, "C"), (None, "C "), (None, "C"), (7, "twice  more"), (8, "twice more")]
    out = sorted(((r.doc_id, r.text) for r in dedup.drop_copies(frame(spark, rows)).collect()), key=repr)
    assert out == sorted([(5, "A"), (3, "B"), (9, "twice"), (None, "C"), (None, "C "), (7, "twice  more")], key=repr)


def test_empty_table(spark):
    assert dedup.exact_groups(frame(spark, [])).collect() == []
