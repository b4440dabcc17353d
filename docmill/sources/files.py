"""Files as rows: batch and stream scans, content guards."""

from __future__ import annotations

import shlex
import subprocess
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions import text as X

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def scan(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length, content of files; a filter on length is pushed to the scan."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def stream(spark: SparkSession, path: str, per_trigger: int = 1000, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def named(files: DataFrame) -> DataFrame:
    """With doc_id (128 bits of a hash of the path), filename and ext."""
    return files.withColumn("doc_id", F.md5("path")).withColumn("filename", X.basename(F.col("path"))).withColumn("ext", X.extension(F.col("filename")))


ENTRIES = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("file_size", T.LongType()), T.StructField("compress_size", T.LongType())])


def zip_entries(files: DataFrame) -> DataFrame:
    """A row per archive member of (doc_id, content); files that are no archives give none."""

    def run(batches):
        import pandas as pd

        from docmill.sources.office import entries

        for batch in batches:
            rows = [(d, *e) for d, c in zip(batch["doc_id"], batch["content"], strict=True) for e in entries(bytes(c or b""))]
            yield pd.DataFrame(rows, columns=ENTRIES.names)

    return files.select("doc_id", "content").mapInPandas(run, ENTRIES)


def scanned(files: DataFrame, command: str, timeout: int = 60) -> DataFrame:
    """(doc_id, error_kind) of files that an outside scanner does not pass: another exit code than 0, or no end in time. The
    file's path is the command's last argument; a scanner that is missing fails the job rather than passing files."""
    schema = "doc_id string, error_kind string"

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for d, c in zip(batch["doc_id"], batch["content"], strict=True):
                with tempfile.TemporaryDirectory() as folder:
                    at = Path(folder) / "file"
                    at.write_bytes(bytes(c or b""))
                    try:
                        bad = subprocess.run([*shlex.split(command), str(at)], capture_output=True, timeout=timeout).returncode != 0
                    except subprocess.TimeoutExpired:
                        bad = True
                if bad:
                    rows.append((d, "malicious_file"))
            yield pd.DataFrame(rows, columns=["doc_id", "error_kind"])

    return files.select("doc_id", "content").mapInPandas(run, schema)
