"""Files to results: guard, route, read, gate, describe, project.

Text files stay in column expressions. Other formats go through one Arrow pass that keeps what was read; heavy ones in child
processes that can be killed. PDF words and mailbox messages come out of that pass as rows, and layout and caps are DataFrame
steps. Guards are filters before the pass, so nothing that was refused is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill import errors, registry, schema
from docmill.conf import Settings, checked_mode
from docmill.functions import language as L
from docmill.functions import text as X
from docmill.operators import layout as G
from docmill.operators import relational as R
from docmill.plans.store import outside, written
from docmill.sources import files as S

_WORD = T.StructType([f for f in schema.WORDS.fields if f.name != "doc_id"])
_MESSAGE = T.StructType([T.StructField("index", T.IntegerType()), T.StructField("mail", schema.MAIL), T.StructField("error", T.StringType())])
_PDF = T.StructType([T.StructField(x, T.StringType()) for x in ("created", "modified", "creator")] + [T.StructField("width", T.DoubleType())])
_IMAGE = T.StructType([T.StructField("seq", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("sha1", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("text", T.StringType())])
READ = T.StructType(
    [T.StructField("doc_id", T.StringType()), *schema.PARSED.fields, T.StructField("words", T.ArrayType(_WORD)), T.StructField("messages", T.ArrayType(_MESSAGE)), T.StructField("pdf", _PDF), T.StructField("images", T.ArrayType(_IMAGE)), T.StructField("engine", T.StringType())]
)
_LIGHT = ("text", "markdown")
#: Bytes of files, and files, whose results go on together: a batch of every column of READ costs much more than a small file.
BATCH = (1 << 20, 256)


def _shaped(value, kind: T.DataType):
    """A value with every field that `kind` has, for Arrow."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _shaped(value.get(f.name), f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [_shaped(x, kind.elementType) for x in value]
    if isinstance(kind, T.MapType):
        return list(value.items())
    return value


def recognised(images: list[tuple[str, bytes]], ocr) -> list[dict]:
    """Embedded images with their sizes and, where `ocr` is given, their text; images that cannot be read have none."""
    import hashlib

    from docmill.sources.plain import image_info

    out = []
    for i, (label, data) in enumerate(images):
        try:
            _, w, h = image_info(data)
        except errors.DocumentError:
            w = h = None
        text = None
        if ocr is not None and w is not None:
            try:
                text = ocr(data, label)
            except Exception:  # an image that fails is skipped, the document stays
                text = None
        out.append({"seq": i, "label": label, "sha1": hashlib.sha1(data).hexdigest(), "width": w, "height": h, "text": text})
    return out


def read(files: DataFrame, settings: Settings, structured: bool, ocr=None) -> DataFrame:
    """READ rows of (doc_id, parser, ext, heavy, content). Heavy ones are read in a child process that can be killed, as many at a
    time on a machine as the settings allow; others are read at once."""
    extra = dict(registry.KERNELS)

    def one(parser, ext, data):
        from docmill.sources.kernels import parse

        found = parse(parser, ext, data, settings, structured, extra)
        if found.get("images") is not None:
            found["images"] = recognised(found["images"], ocr) if settings.ocr_embedded else None
        if parser == "image" and found.get("error_kind") is None and ocr is not None:
            found["structured"] = {"text": ocr(data, "")}
        return found

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        from docmill.plans.isolate import Child, slot

        want = to_arrow_schema(READ)
        child = Child(one, settings.worker_timeout_s)
        rows, size = [], 0

        def batched():
            return pa.RecordBatch.from_arrays([pa.array([_shaped(r.get(f.name), f.dataType) for r in rows], w.type) for f, w in zip(READ.fields, want, strict=True)], schema=want)

        for batch in batches:
            for i in range(batch.num_rows):
                d, parser, ext, heavy, data = (batch.column(k)[i].as_py() for k in range(5))
                if heavy:
                    with slot(settings.max_concurrent_heavy):
                        found = {**child(parser, ext, data or b""), "doc_id": d}
                else:
                    found = {**one(parser, ext, data or b""), "doc_id": d}
                found["parser"] = found.get("parser") or parser
                rows.append(found)
                size += len(data or b"")
                if size >= BATCH[0] or len(rows) >= BATCH[1]:
                    yield batched()
                    rows, size = [], 0
        if rows:
            yield batched()
        child.stop()

    return files.select("doc_id", "parser", "ext", "heavy", "content").mapInArrow(run, READ)


def _metadata(**given: Column) -> Column:
    """schema.METADATA with the given fields; empty strings are null."""
    out = []
    for f in schema.METADATA.fields:
        c = given.get(f.name, F.lit(None)).cast(f.dataType)
        out.append((X.drop_empty(c) if isinstance(f.dataType, T.StringType) else c).alias(f.name))
    return F.struct(*out)


def _light(files: DataFrame) -> DataFrame:
    text = X.decoded(F.col("content"))
    nothing = lambda kind: F.lit(None).cast(kind)
    fields = [(F.col("text") if f.name == "text" else nothing(f.dataType)).alias(f.name) for f in schema.STRUCTURED.fields]
    return files.withColumn("text", text).select("doc_id", F.col("parser"), F.col("text").alias("markdown"), F.struct(*fields).alias("structured"), _metadata().alias("metadata"), nothing(schema.STATS).alias("stats"), nothing("string").alias("error_kind"), nothing("string").alias("error"))


_OUT = ["doc_id", *schema.PARSED.names]


def _pdfs(got: DataFrame, sizes: DataFrame, settings: Settings) -> DataFrame:
    """Words of PDFs to markdown, pages and gates."""
    ok = got.where("parser = 'pdf' AND error_kind IS NULL")
    words = ok.select("doc_id", F.explode("words").alias("w")).select("doc_id", "w.*")
    pages = ok.where("metadata.page_count > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("metadata.page_count"))).alias("page"))
    laid = G.pdf_markdown(words, pages, right=settings.pdf_crop_right, top=settings.pdf_crop_top, together=True)
    j = ok.drop("markdown").join(laid, "doc_id", "left").join(sizes.select("doc_id", "length"), "doc_id")
    markdown = F.coalesce("markdown", F.lit(""))
    needs = X.needs_ocr(markdown, F.col("metadata.page_count"), F.col("pdf.creator"), F.col("length"), settings.ocr_min_chars_per_page, settings.ocr_min_chars_per_heavy_page, settings.heavy_bytes_per_page)
    garbage = F.coalesce("garbage", F.lit(0.0)) > settings.garbage_ratio
    kind = F.when(garbage | needs, "needs_ocr")
    why = F.when(garbage, "the text layer is glyph codes").when(needs, "too little text per page")
    m = F.col("metadata")
    meta = _metadata(**{f: m[f] for f in schema.METADATA.names} | {"created": X.pdf_date(F.col("pdf.created")), "modified": X.pdf_date(F.col("pdf.modified"))})
    split = F.filter(F.split(markdown, r"(?m)^(?=## Page \d+$)"), lambda x: x.startswith("## Page "))
    numbered = F.transform(split, lambda x: F.struct(F.regexp_extract(x, r"^## Page (\d+)", 1).cast("int").alias("page"), F.trim(F.regexp_replace(x, r"^## Page \d+\n*", "")).alias("markdown")))
    structured = F.struct(*[(numbered if f.name == "pages" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.STRUCTURED.fields])
    return j.select("doc_id", "parser", markdown.alias("markdown"), structured.alias("structured"), meta.alias("metadata"), "stats", kind.alias("error_kind"), why.alias("error"))


def _mailboxes(got: DataFrame, names: DataFrame, settings: Settings) -> DataFrame:
    """Messages of mailboxes, up to the cap, under a heading."""
    ok = got.where("parser = 'mbox' AND error_kind IS NULL")
    each = ok.select("doc_id", F.explode("messages").alias("x")).select("doc_id", F.col("x.index").alias("i"), F.col("x.mail").alias("mail"), F.col("x.error").alias("failure"))
    failed = F.col("mail").isNull()
    shown = F.when(failed, F.format_string("## Message %d\n\n(parse error: %s)", "i", "failure")).otherwise(R.mail_markdown(F.col("mail"), F.col("i")))
    kept = R.capped(each.withColumn("text", shown), "doc_id", "i", "text", settings.mbox_max_chars, failed)
    rows = F.sort_array(F.collect_list(F.struct("i", "text")))
    messages = F.sort_array(F.collect_list(F.when(~failed, F.struct(F.col("i").alias("index"), F.col("mail")))))
    by = kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"), F.max("i").alias("last"), F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n").alias("body"), messages.alias("messages_kept"))
    j = ok.select("doc_id", "parser", "stats", F.size("messages").alias("total")).join(by, "doc_id", "left").join(names.select("doc_id", "filename"), "doc_id")
    cut = F.col("kept") < F.col("total")
    fields = {"messages": F.col("messages_kept"), "truncated_after": F.when(cut, F.col("last"))}
    structured = F.struct(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.STRUCTURED.fields])
    head = R.mailbox_header(F.col("filename"), F.col("kept"), F.col("total"), settings.mbox_max_chars >> 20)
    empty = F.col("kept").isNull()
    return j.select("doc_id", "parser", F.concat(head, "body").alias("markdown"), structured.alias("structured"), _metadata(message_count=F.col("kept")).alias("metadata"), "stats", F.when(empty, "invalid_mbox").alias("error_kind"), F.when(empty, "no message within the cap").alias("error"))


def _described(got: DataFrame, names: DataFrame, settings: Settings) -> DataFrame:
    """Formats whose kernel gives all but a rendering: mail, images, embedded images."""
    mail = F.col("structured.mail")
    section = R.image_section(R.embedded_images(got.where("images IS NOT NULL").select("doc_id", F.explode("images").alias("x")).select("doc_id", "x.*"), "doc_id", "seq", settings.ocr_min_pixels, settings.ocr_max_images), "doc_id", "seq")
    j = got.join(section, "doc_id", "left").join(names.select("doc_id", "filename"), "doc_id")
    said = F.col("structured.text")
    picture = F.concat(F.lit("# Image: "), "filename", F.lit("\n\n"), F.when(F.length(said) > 0, said).otherwise("(no text detected)"))
    markdown = F.when(F.col("parser").isin("email", "msg") & F.col("error_kind").isNull(), R.mail_markdown(mail)).when((F.col("parser") == "image") & F.col("error_kind").isNull(), picture).otherwise(F.concat_ws("\n\n", "markdown", "section"))
    return j.withColumn("markdown", markdown).select(*_OUT)


def convert(files: DataFrame, mode: str | None = None, settings: Settings | None = None, ocr=None) -> DataFrame:
    """Results of (path, length, content) files: doc_id, filename, ext, bytes, mode, parser, markdown, structured, metadata,
    stats, status, error_kind, error; structured is null in markdown mode, markdown in structured mode.
    The readers' pass runs when this is called, into the shared folder; the rest is lazy.

    ocr(bytes, label) -> text is called for images where given; without it images have no text. Every file that the
    scan returns gives one row (Spark's file scan leaves out files of no bytes)."""
    settings = settings or Settings.of(files.sparkSession)
    mode = checked_mode(mode, settings)
    structured = mode != "markdown"
    f = S.named(files)
    if settings.verify_mime:
        f = f.withColumn("ext", X.rerouted(F.col("ext"), F.col("content")))
    f = registry.routed(f)
    limit = settings.max_file_mb << 20
    refused = F.when(F.col("filename") == "", "bad_request").when(F.lit(limit > 0) & (F.col("length") > limit), "too_large").when(F.col("parser").isNull(), "unsupported").when((F.col("parser") == "mbox") & ~X.mbox_signed(F.col("content")), "invalid_mbox")
    # What is known of a file without reading it is written once; everything below but the readers goes by that.
    f = f.withColumn("error_kind", refused).withColumn("zipped", F.hex(F.substring("content", 1, 4)) == "504B0304")
    names = written(f.select("doc_id", "filename", "ext", "length", "parser", "error_kind", "zipped"), "names")
    bad = names.where("error_kind IS NOT NULL").select("doc_id", "error_kind")
    good = f.where("error_kind IS NULL").drop("error_kind")
    unsafe = written(R.archive_verdicts(S.zip_entries(good.where("zipped")), "doc_id", settings.zip_max_entries, settings.zip_max_total_mb << 20, settings.zip_max_ratio).where("reason IS NOT NULL").select("doc_id", F.lit("decompression_bomb").alias("error_kind")), "verdicts")
    good = outside(good, "doc_id", unsafe)
    if settings.scan_command:
        unsafe_too = written(S.scanned(good, settings.scan_command, settings.scan_timeout_s), "scanned")
        good = outside(good, "doc_id", unsafe_too)
        unsafe = unsafe.unionByName(unsafe_too)
    heavy = F.col("heavy") | F.lit(settings.ocr_embedded and ocr is not None) & (F.col("parser") == "docx")
    # Each file is read once, whatever the number of branches below.
    got = written(read(good.where(~F.col("parser").isin(*_LIGHT)).withColumn("heavy", heavy), settings, structured, ocr), "read")
    plain = _described(got.where("NOT (parser IN ('pdf', 'mbox') AND error_kind IS NULL)"), names, settings)
    parsed = _light(good.where(F.col("parser").isin(*_LIGHT))).unionByName(plain).unionByName(_pdfs(got, names, settings)).unionByName(_mailboxes(got, names, settings))
    nothing = [F.lit(None).cast(x.dataType).alias(x.name) for x in schema.PARSED.fields if x.name != "error_kind"]
    failed = bad.unionByName(unsafe).select("doc_id", "error_kind", *nothing)
    joined = names.select("doc_id", "filename", "ext", F.col("length").alias("bytes"), F.col("parser").alias("routed")).join(parsed.unionByName(failed.select(*_OUT)), "doc_id", "left")
    kind = F.col("error_kind")
    ok = kind.isNull()
    text = X.normalised_markdown(F.col("markdown"))
    m = F.col("metadata")
    given = {n: m[n] for n in schema.METADATA.names} | {"source": F.col("filename"), "language": L.language(text, settings.language_sample_chars) if settings.detect_language else F.lit(None)}
    return joined.select(
        "doc_id", "filename", "ext", "bytes", F.lit(mode).alias("mode"), F.coalesce("parser", "routed").alias("parser"),
        F.when(ok & F.lit(mode != "structured"), text).alias("markdown"), F.when(ok & F.lit(structured), F.col("structured")).alias("structured"),
        F.when(ok, _metadata(**given)).alias("metadata"), F.when(ok, F.col("stats")).alias("stats"), errors.status(kind).alias("status"), "error_kind", errors.message(F.coalesce("error", "error_kind")).alias("error"))


def dead_letters(results: DataFrame) -> DataFrame:
    return results.where("status <> 200").select("doc_id", "filename", "ext", "status", "error_kind", "error")


def as_json(results: DataFrame) -> DataFrame:
    """(doc_id, value): one JSON object per file, without fields that are null."""
    return results.select("doc_id", F.to_json(F.struct(*[c for c in results.columns if c != "doc_id"])).alias("value"))


def write(results: DataFrame, path: str, dead_letter_path: str | None = None, form: str = "parquet") -> None:
    """Good rows by extension, others where they can be looked at."""
    results.where("status = 200").write.mode("append").partitionBy("ext").format(form).save(path)
    if dead_letter_path:
        dead_letters(results).write.mode("append").format("json").save(dead_letter_path)
