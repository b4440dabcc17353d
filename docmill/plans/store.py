"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a filter of hashed values, at least and at most (32 MB).
FILTER_BITS = (20, 28)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset one is made, but only for a local master: executors on other
    machines would each write to a folder of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="docmill-shared-")
        shared_dir.own = folder
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and read back: branches share one pass, and a lost executor costs a reread and no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def marked(rows: DataFrame, by: Column, values: DataFrame, name: str, often: bool = False) -> DataFrame:
    """Rows with a column `name`: false only where `by` is none of the only column of `values`, a written table.

    A bitmap of 256 to 512 bits a value, of 32 MB at most whatever the number of values, is sent to all tasks as a small table,
    so that rows are told apart where they are read, without a shuffle. `often`: it is written, for plans that use it many times."""
    bits = min(max(FILTER_BITS[0], (256 * values.count()).bit_length()), FILTER_BITS[1])
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    part = lambda c: F.shiftright(c, 15)  # noqa: E731  of 2 ** 15 bits
    inner = F.col("__place").bitwiseAND(F.lit((1 << 15) - 1))
    bitmap = values.select(place(values.columns[0]).alias("__place")).select(part("__place").alias("__part"), inner.alias("__bit"))
    bitmap = bitmap.groupBy("__part").agg(F.bitmap_construct_agg("__bit").alias("b"))
    eight = lambda i: F.conv(F.hex(F.substring("b", i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    bitmap = bitmap.select("__part", F.transform(F.sequence(F.lit(0), F.lit(511)), eight).alias("__bits"))
    if often:
        bitmap = written(bitmap, "filter")
    # Eight bytes are one number, the first of them its highest.
    word = F.get("__bits", F.shiftright(inner, 6).cast("int"))
    at = (F.lit(56) - F.shiftright(inner, 3).bitwiseAND(F.lit(7)) * 8 + inner.bitwiseAND(F.lit(7))).cast("int")
    placed = rows.withColumn("__place", place(by)).withColumn("__part", part("__place")).join(F.broadcast(bitmap), "__part", "left")
    bit = F.coalesce(F.bit_get(word, at), F.lit(0))
    return placed.select(*[placed[f"`{c}`"] for c in rows.columns], (bit == 1).alias(name))


def likely_among(rows: DataFrame, by: Column, values: DataFrame) -> DataFrame:
    """Rows whose `by` may be among `values`, as marked() has it."""
    return marked(rows, by, values, "__likely").where("__likely").drop("__likely")


def outside(rows: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """Rows whose key is not in the column of that name of `values`, a written table; only those that the filter cannot tell are moved."""
    told = marked(rows, F.col(key), values.select(key), "__hit")
    return told.where("NOT __hit").unionByName(told.where("__hit").join(values.select(key), key, "left_anti")).select(*rows.columns)


def dropped(df: DataFrame) -> None:
    """Delete the files of a written() table that no later plan reads."""
    spark = df.sparkSession
    own = shared_dir(spark).rpartition(":")[2].strip("/")
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if f"/{own}/" in path:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
