"""What the two classifiers share: labelled rows to fit on, one task that fits, and scores of whole tables."""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket, resident, written

FOLDS, HELD = 4, 2
SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def sample(docs: DataFrame, labels: DataFrame, label: str, each: int, id_col: str, text_col: str) -> DataFrame:
    """(text, label, turn) of up to `each` rows of either label that are not held out, by a hash of the id.

    Null ids and labels are left out; a row with several labels has the one that more of them say, 0 on a tie. The ids, two
    times `each` at most, go to the documents, so texts that are not drawn are not shuffled."""
    y = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
    y = y.agg((F.avg(F.col(label).cast("double")) > 0.5).cast("int").alias("label")).where(bucket("doc_id", FOLDS) != HELD)
    turn = F.xxhash64(F.col("doc_id"), F.lit(11))
    drawn = None
    for value in (0, 1):
        part = y.where(F.col("label") == value).withColumn("turn", turn).orderBy("turn", "doc_id").limit(each)
        drawn = part if drawn is None else drawn.unionByName(part)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.join(F.broadcast(written(drawn, "drawn")), "doc_id").select("text", "label", "turn")


def fitted(rows: DataFrame, fit):
    """fit(texts, labels) in one task over the bounded sample, in the order of `turn`; returns its model (None without rows)."""

    def run(batches):
        import pyarrow as pa

        got = []
        for b in batches:
            got += zip(b.column("turn").to_pylist(), b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True)
        got.sort()
        if got:
            model = pickle.dumps(fit([x[1] for x in got], [x[2] for x in got]))
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    found = written(rows.repartition(1).mapInArrow(run, "model binary"), "model").first()
    return pickle.loads(found[0]) if found else None


def kept(docs: DataFrame, model, scorer, keep, text_col: str) -> DataFrame:
    """The rows of docs, with all their columns, for whose score keep(score) holds, in one pass without a shuffle."""
    key = hash(pickle.dumps(model))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        score = resident((scorer.__module__, key), lambda: scorer(sent.value)) if sent.value is not None else lambda texts: [0.5] * len(texts)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield part.filter(pa.array([bool(keep(float(x))) for x in score([t or "" for t in part.column(at_text).to_pylist()])], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def scores(docs: DataFrame, model, scorer, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """scorer(model) gives a function from texts to numbers from 0 to 1; without a model all are 0.5."""
    key = hash(pickle.dumps(model))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (bucket(F.col(id_col), FOLDS) == HELD).alias("held_out"))

    def run(batches):
        import pyarrow as pa

        score = resident((scorer.__module__, key), lambda: scorer(sent.value)) if sent.value is not None else lambda texts: [0.5] * len(texts)
        for batch in batches:
            got = []
            for at in range(0, batch.num_rows, 256):
                got += [float(x) for x in score([t or "" for t in batch.column(1)[at : at + 256].to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.float64()), pa.array([int(x >= threshold) for x in got], pa.int32())], names=SCORED.names)

    return own.mapInArrow(run, SCORED)
