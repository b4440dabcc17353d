"""Exact deduplication by a log-structured merge index, with DataFrame operations only.

Memtables flush: each task sorts its documents' digests and writes them; the files of the tasks that share a number modulo
MEMTABLES are a run of level 0. Levels merge: FANOUT runs at a time become one of the next level, keeping the smallest
identifier and the number of rows of a digest (partial sums per task come before the shuffle, so a digest held by a
third of all rows is a few rows per task), until one run is left. Digests with more than one row are hits. A filter, a
bitmap of hashed digests, is looked up for every document: texts that are no hits are left out where they are read, the others
are compared byte for byte. Runs that come later are looked up in the same way (DigestIndex.lookup).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import likely_among, marked, new_path, written

#: Runs of a level that are merged into one of the next, and runs that a whole table is flushed as.
FANOUT, MEMTABLES = 4, 16


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(r"[\x09-\x0D]|  "), F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")).otherwise(text)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


class DigestIndex:
    """Runs of (digest, id, rows) by level in a shared folder. `runs` is the manifest: level -> (path, number of the run there)."""

    def __init__(self, spark: SparkSession, id_type: T.DataType | None = None, folder: str | None = None, fanout: int = FANOUT) -> None:
        self.spark, self.folder, self.fanout = spark, folder or new_path(spark, "digests"), fanout
        self.schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("id", id_type or T.LongType()), T.StructField("rows", T.LongType()), T.StructField("run", T.IntegerType())])
        self.runs: dict[int, list[tuple[str, int]]] = {}
        self._made = 0

    def _write(self, rows: DataFrame, level: int, runs: int) -> None:
        """Rows with their run (from 0) as runs of a level: files sorted by run and digest, one a task, with Parquet filters on the digest."""
        self._made += 1
        path = f"{self.folder}/level={level}/made={self._made}"
        rows.select(*self.schema.names).sortWithinPartitions("run", "digest", "id").write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)
        self.runs.setdefault(level, []).extend((path, k) for k in range(runs))

    def read(self, runs: list[tuple[str, int]]) -> DataFrame:
        """Runs one after another, `run` being the place in the list."""
        out = None
        for path in dict.fromkeys(p for p, _ in runs):
            numbers = {k: at for at, (p, k) in enumerate(runs) if p == path}
            part = self.spark.read.schema(self.schema).parquet(path).where(F.col("run").isin(*numbers))
            part = part.withColumn("run", F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv])[F.col("run")])
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], self.schema)

    def flush(self, rows: DataFrame, memtables: int = 1) -> DataFrame:
        """Write a batch (digest, id) as runs of level 0; merge levels that are full. Returns the batch as written."""
        self._write(rows.select("digest", "id", F.lit(1).cast("long").alias("rows"), F.pmod(F.spark_partition_id(), F.lit(memtables)).alias("run")), 0, memtables)
        batch = self.spark.read.schema(self.schema).parquet(self.runs[0][-1][0])
        level = 0
        while len(self.runs.get(level, ())) >= self.fanout:
            self._merge(level)
            level += 1
        return batch

    def _merge(self, level: int) -> None:
        """All runs of a level, `fanout` at a time, become runs of the next one."""
        runs = self.runs.pop(level)
        rows = self.read(runs).withColumn("run", F.floor(F.col("run") / F.lit(self.fanout)).cast("int"))
        self._write(rows.groupBy("run", "digest").agg(F.min("id").alias("id"), F.sum("rows").alias("rows")), level + 1, -(-len(runs) // self.fanout))

    def compact(self) -> DataFrame:
        """Merge all runs into one of the highest level and return it: (digest, id, rows)."""
        while sum(map(len, self.runs.values())) > 1:
            level = min(self.runs)
            if len(self.runs[level]) == 1:  # goes up as it is
                self.runs[level + 1] = self.runs.pop(level) + self.runs.get(level + 1, [])
            else:
                self._merge(level)
        return self.read([r for runs in self.runs.values() for r in runs]).drop("run")

    def lookup(self, rows: DataFrame) -> DataFrame:
        """Rows whose digest some run holds: the filter leaves out most others before they are moved."""
        held = written(self.read([r for runs in self.runs.values() for r in runs]).select("digest").distinct(), "held")
        return likely_among(rows, F.col("digest"), held).join(held, "digest", "left_semi")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts are those whose normalised forms have the same bytes; null counts as empty. keep_id is the
    smallest id of the group (null only if all its ids are null); kept is doc_id <=> keep_id, so rows that repeat
    an id with the same text stay or go together. An empty table gives an empty result; other columns are left out.
    Two different texts with the same digest are told apart by their bytes and grouped separately; with another `digest`
    than sha256, text_sha256 is null."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t"))
    own = own.select("id", "t", digest(F.col("t")).alias("digest"))
    index = DigestIndex(spark, own.schema["id"].dataType)
    run = index.flush(own, MEMTABLES)
    top = index.compact()
    hits = written(top.where("rows > 1"), "hits")
    digests = hits.select("digest")
    # Byte verification of the hits: the filter leaves out other texts, equal texts collapse in each task before the shuffle.
    found = likely_among(own, F.col("digest"), digests).join(digests, "digest", "left_semi")
    texts = found.groupBy("digest", "t").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    clash = written(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "clashes")
    # Only rows of hits meet their group; all others are their own.
    rows = marked(run.select("digest", F.col("id").alias("doc_id")), F.col("digest"), digests, "hit")
    alone = rows.where("NOT hit").select("digest", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    known = hits.select("digest", F.col("id").alias("first_id"), F.col("rows").alias("group_rows"), F.lit(True).alias("known"))
    shared = rows.where("hit").join(known, "digest", "left")
    shared = shared.select("digest", "doc_id", F.when(F.col("known"), F.col("first_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("group_rows", F.lit(1)).cast("long").alias("group_size"))
    groups = alone.unionByName(shared)
    if not clash.isEmpty():
        mixed = own.join(clash, "digest", "left_semi").withColumnRenamed("id", "doc_id").join(texts, ["digest", "t"])
        groups = groups.join(clash, "digest", "left_anti").unionByName(mixed.select(groups.columns))
    groups = groups.withColumn("text_sha256", F.lower(F.hex("digest")) if digest is sha256 else F.lit(None).cast("string"))
    return groups.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, one with the smallest id, with all its columns."""
    groups = written(exact_groups(docs, id_col, text_col).where("group_size > 1"), "copies")
    keep = groups.where("kept").groupBy(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_sha"))
    keep = written(keep.agg((F.count(F.lit(1)) > 1).alias("__again")), "kept")
    # Rows whose id the filter knows to be of no group stay where they are, their texts unread.
    own = marked(docs, F.col(id_col), groups.select("doc_id"), "__hit")
    hit = own.where("__hit").withColumn("__sha", F.lower(F.hex(sha256(normalised(F.col(text_col))))))
    alone = own.where("NOT __hit").select(*docs.columns).unionByName(hit.join(groups.select(F.col("text_sha256").alias("__sha")).distinct(), "__sha", "left_anti").select(*docs.columns))
    joined = hit.join(keep, hit[id_col].eqNullSafe(keep["__kept_id"]) & (hit["__sha"] == keep["__kept_sha"]))
    # Only rows that repeat an id with the same text need meet.
    once = alone.unionByName(joined.where("NOT __again").select(*docs.columns))
    if keep.where("__again").isEmpty():
        return once
    return once.unionByName(joined.where("__again").dropDuplicates([id_col, "__sha"]).select(*docs.columns))
