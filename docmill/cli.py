"""`python -m docmill.cli FILE...`: results as JSON; `--bench FOLDER [--json FILE]`: a report by extension, and records; `--formats`, `--health`."""

from __future__ import annotations

import argparse
import json
import shutil
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill import registry
from docmill.conf import Settings, checked_mode
from docmill.operators import relational as R
from docmill.plans import pipeline
from docmill.sources import files


def health() -> dict:
    """Which outside programs are there; none of them is needed."""
    return {"status": "ok", "tools": {x: shutil.which(x) is not None for x in ("soffice", "tesseract", "pandoc")}}


def read_times(chosen: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, ms): how long the reader of each file takes, one after another in a task."""
    extra = dict(registry.KERNELS)

    def run(batches):
        import pandas as pd

        from docmill.sources.kernels import parse
        from docmill.sources.plain import decoded

        for batch in batches:
            took = []
            for parser, ext, data in zip(batch["parser"], batch["ext"], batch["content"], strict=True):
                began = time.perf_counter()
                if parser in ("text", "markdown"):
                    decoded(bytes(data or b""))
                elif parser:
                    parse(parser, ext, bytes(data or b""), settings, False, extra)
                took.append((time.perf_counter() - began) * 1000)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ms": took})

    return registry.routed(files.named(chosen)).select("doc_id", "parser", "ext", "content").mapInPandas(run, "doc_id string, ms double")


def bench_records(spark: SparkSession, folder: str, per_ext: int, settings: Settings) -> DataFrame:
    """A row for each of up to `per_ext` files of each extension: filename, ext, ok, status, ms (of its reader), parser, error."""
    chosen = R.sampled(files.named(files.scan(spark, folder)), per_ext).select("path", "modificationTime", "length", "content")
    results = pipeline.convert(chosen, "markdown", settings).select("doc_id", "filename", "ext", (F.col("status") == 200).alias("ok"), "status", F.coalesce("parser", F.lit("")).alias("parser"), "error")
    return results.join(read_times(chosen, settings), "doc_id", "left")


def bench(spark: SparkSession, folder: str, per_ext: int, settings: Settings, records: list | None = None):
    """Converts up to `per_ext` files of each extension and reports them by extension and in all; the records go to `records`."""
    rows = bench_records(spark, folder, per_ext, settings).collect()
    if records is not None:
        records += sorted(({k: v for k, v in r.asDict().items() if k != "doc_id"} for r in rows), key=lambda r: (r["ext"] or "", r["filename"]))
    runs = spark.createDataFrame([(r.doc_id, r.ext, r.ok, float(r.ms or 0), r.parser, r.error) for r in rows], "seq string, ext string, ok boolean, ms double, parser string, error string")
    return R.report(runs).orderBy(F.col("ext").asc_nulls_last())


def with_raster_images(spark: SparkSession, folder: str, want: int):
    """Office files that hold raster images, from their directories alone."""
    f = files.named(files.scan(spark, folder)).where(F.col("ext").isin(".docx", ".pptx", ".xlsx"))
    counts = R.member_counts(files.zip_entries(f), "doc_id").where("raster_count > 0")
    return f.select("doc_id", "path").join(counts, "doc_id").limit(want)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="docmill")
    p.add_argument("paths", nargs="*")
    p.add_argument("--mode", default=None)
    p.add_argument("--bench", metavar="FOLDER")
    p.add_argument("--per-ext", type=int, default=10)
    p.add_argument("--json", metavar="FILE", help="where --bench writes its records")
    p.add_argument("--formats", action="store_true")
    p.add_argument("--health", action="store_true")
    a = p.parse_args(argv)
    if a.health:
        print(json.dumps(health(), indent=2))
        return 0
    try:
        mode = checked_mode(a.mode)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("docmill").getOrCreate()
    if a.formats:
        print(json.dumps([r.ext for r in registry.formats(spark).collect()]))
        return 0
    if a.bench:
        records: list = []
        bench(spark, a.bench, a.per_ext, Settings.of(spark), records).show(100, False)
        if a.json:
            with open(a.json, "w", encoding="utf-8") as f:
                json.dump(records, f, indent=2, ensure_ascii=False)
        return 0
    if not a.paths:
        p.print_usage(sys.stderr)
        return 2
    worst = 0
    for path in a.paths:
        for r in pipeline.as_json(pipeline.convert(files.scan(spark, path), mode)).toLocalIterator():
            found = json.loads(r.value)
            worst = max(worst, int(found["status"] != 200))
            print(json.dumps(found, indent=2, ensure_ascii=False))
    return worst


if __name__ == "__main__":
    sys.exit(main())
