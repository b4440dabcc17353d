"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.plans.store import dropped, likely_among, marked, new_path, written

__all__ = ["Memo", "bucket", "documents", "dropped", "freed", "likely_among", "marked", "new_path", "resident", "tokenizer_path", "written"]


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file; a name with a slash is already a path."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are over: it does so when their plans have been collected."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bucket(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8")), F.lit(n))


class Memo(dict):
    """Results of `make` by key. Of those that have not been asked for lately, `bound` are kept besides `bound` newer ones."""

    def __init__(self, make, bound: int) -> None:
        self.make, self.bound, self.old = make, bound, {}

    def __missing__(self, key):
        got = self.old.pop(key, None)
        if got is None:
            got = self.make(key)
        self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[key] = value


_RESIDENT: dict = {}


def resident(key: tuple, make):
    """What `make` gives, kept in this worker process until another key is asked for: tables that one task has built
    serve the next one, and at most one set of them takes memory; that of the last set goes back to the system."""
    if key not in _RESIDENT:
        if _RESIDENT:
            _RESIDENT.clear()
            _returned()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def _returned() -> None:
    """Give memory that is free in this process back to the system, where its C library can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
