"""Which extension is read how: a small table that lookups are joined to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parser -> extensions.
NATIVE = {
    "pdf": (".pdf",),
    "docx": (".docx",),
    "pptx": (".pptx",),
    "xlsx": (".xlsx", ".xlsm"),
    "csv": (".csv", ".tsv"),
    "email": (".eml",),
    "msg": (".msg",),
    "mbox": (".mbox", ".mbx"),
    "image": (".png", ".jpg", ".jpeg", ".tiff", ".tif", ".gif", ".bmp", ".webp"),
    "text": (".txt",),
    "markdown": (".md", ".markdown"),
    "html": (".html", ".htm"),
    "rtf": (".rtf",),
    "json": (".json",),
}
#: Older and open formats -> the format they are read as.
LEGACY = {".doc": ".docx", ".odt": ".docx", ".ppt": ".pptx", ".pps": ".pptx", ".pot": ".pptx", ".ppsx": ".pptx", ".odp": ".pptx", ".xls": ".xlsx", ".ods": ".xlsx"}
HEAVY = frozenset({"pdf", "pptx", "xlsx", "csv", "mbox"})


@dataclass(frozen=True)
class Format:
    ext: str
    parser: str
    target: str | None = None
    heavy: bool = False


def _built_in() -> dict[str, Format]:
    out = {e: Format(e, p, None, p in HEAVY) for p, es in NATIVE.items() for e in es}
    return out | {e: Format(e, out[t].parser, t, True) for e, t in LEGACY.items()}


FORMATS: dict[str, Format] = _built_in()
#: Kernels that were added: parser -> function(bytes, ext, settings, structured) -> dict.
KERNELS: dict = {}


def register_format(ext: str, parser: str, kernel=None, heavy: bool = False) -> None:
    """Add or replace an extension; `kernel` is a function of a module that executors can import."""
    ext = ext.lower() if ext.startswith(".") else f".{ext.lower()}"
    FORMATS[ext] = Format(ext, parser, None, heavy)
    if kernel is not None:
        KERNELS[parser] = kernel


def table(spark: SparkSession) -> DataFrame:
    """(ext, parser, target, heavy), one row per extension: a few dozen rows."""
    return spark.createDataFrame([(f.ext, f.parser, f.target, f.heavy) for f in FORMATS.values()], "ext string, parser string, target string, heavy boolean")


def routed(files: DataFrame, ext: str = "ext", how: str = "left") -> DataFrame:
    """files with parser, heavy and read_as (the extension its content is treated as); null parser: unsupported."""
    t = table(files.sparkSession).withColumnRenamed("ext", "__ext")
    return files.join(F.broadcast(t), files[ext] == t["__ext"], how).withColumn("read_as", F.coalesce("target", "__ext")).drop("__ext", "target")


def formats(spark: SparkSession) -> DataFrame:
    return table(spark).select("ext", "parser").orderBy("ext")


def in_families(ext: Column) -> Column:
    """`pdf`, `image` or null, by extension."""
    return F.when(ext == ".pdf", "pdf").when(ext.isin(*NATIVE["image"]), "image")
