"""The other set-based steps: mailboxes, archives, images, equations, tables and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import text as X


def mail_markdown(m: Column, index: Column | None = None) -> Column:
    """A message (schema.MAIL) as markdown: headers that are there, body, attachments."""
    some = lambda label, c: F.when(F.length(c) > 0, F.concat(F.lit(f"**{label}:** "), c))
    always = lambda label, c: F.concat(F.lit(f"**{label}:** "), F.coalesce(c, F.lit("")))
    head = F.concat_ws("  \n", always("From", m["from"]), always("To", m["to"]), some("Cc", m["cc"]), some("Bcc", m["bcc"]), some("Reply-To", m["reply_to"]), some("Date", m["date"]), some("Message-ID", m["message_id"]), some("In-Reply-To", m["in_reply_to"]), some("References", m["references"]))
    files = F.array_join(F.transform(m["attachments"], lambda a: F.concat(a["name"], F.lit(" ("), X.size_label(a["size"]), F.lit(")"))), ", ")
    tail = F.when(F.size(m["attachments"]) > 0, F.concat(F.lit("\n---\n\n**Attachments:** "), files))
    number = F.concat(F.lit("## Message "), index.cast("string"), F.lit("\n")) if index is not None else F.lit(None).cast("string")
    return F.concat_ws("\n", number, F.concat(F.lit("# Subject: "), m["subject"], F.lit("\n")), head, F.lit("\n---\n"), m["body"], tail)


def capped(messages: DataFrame, box: str, index: str, text: str, cap: int, failed: Column | None = None) -> DataFrame:
    """Messages up to the first that would bring a mailbox above `cap` characters (two more are counted for each); those that
    failed to parse are as long as nothing. Adds `size`, the sum so far."""
    own = F.length(text) + 2
    size = F.sum(F.when(failed, 0).otherwise(own) if failed is not None else own)
    w = Window.partitionBy(box).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("size", size.over(w).cast("long")).where(F.col("size") <= cap)


def mailbox_header(name: Column, kept: Column, total: Column, cap_mb: int = 50) -> Column:
    cut = F.format_string(f"# Mailbox: %s (%d messages extracted; output truncated at message %d — {cap_mb}MB cap reached, remaining messages omitted)\n", name, kept, kept)
    return F.when(kept < total, cut).when(kept == 1, F.concat(F.lit("# Mailbox: "), name, F.lit(" (1 message)\n"))).otherwise(F.format_string("# Mailbox: %s (%d messages)\n", name, kept))


def mailboxes(messages: DataFrame, box: str, index: str, text: str, cap: int) -> DataFrame:
    """(box, message_count, truncated, markdown) of mailboxes that keep any message."""
    total = messages.groupBy(box).agg(F.count(F.lit(1)).alias("total"))
    kept = capped(messages, box, index, text, cap).groupBy(box).agg(F.count(F.lit(1)).alias("kept"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), F.col(text).alias("t")))), lambda r: r["t"]), "\n\n").alias("body"))
    both = kept.join(total, box)
    return both.select(box, F.col("kept").alias("message_count"), (F.col("kept") < F.col("total")).alias("truncated"), F.concat(mailbox_header(F.col(box).cast("string"), F.col("kept"), F.col("total")), F.col("body")).alias("markdown"))


def archive_verdicts(entries: DataFrame, key: str, max_entries: int = 10_000, max_total: int = 1024 << 20, max_ratio: int = 200, big: int = 1 << 20) -> DataFrame:
    """(key, entries, total, reason) of archives: too many entries, too large in all (0: any size), or an entry above `big`
    that shrinks by more than max_ratio; null reason: safe."""
    bomb = (F.col("file_size") > big) & (F.col("compress_size") > 0) & (F.col("file_size") > F.col("compress_size") * max_ratio)
    a = entries.groupBy(key).agg(F.count(F.lit(1)).alias("entries"), F.sum("file_size").cast("long").alias("total"), F.bool_or(bomb).alias("bomb"))
    reason = F.when(F.col("entries") > max_entries, "too_many_entries").when(F.lit(max_total > 0) & (F.col("total") > max_total), "too_large").when(F.col("bomb"), "ratio")
    return a.select(key, "entries", "total", reason.alias("reason"))


#: Members that are counted.
SLIDE, SHEET = r"^ppt/slides/slide\d+\.xml$", r"^xl/worksheets/sheet\d+\.xml$"
MEDIA = r"(?i)^(word|ppt|xl)/media/.*\.(png|jpe?g|gif|bmp|tiff?|webp)$"


def member_counts(entries: DataFrame, key: str) -> DataFrame:
    """Slides, sheets and raster images of office archives, from their directories alone."""
    n = lambda p, name: F.count_if(F.col("name").rlike(p)).cast("int").alias(name)
    return entries.groupBy(key).agg(n(SLIDE, "slide_count"), n(SHEET, "sheet_count"), n(MEDIA, "raster_count"))


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")


#: What recognition gives for an image without text.
EMPTY_OCR = ("(no text detected)", "")


def embedded_images(images: DataFrame, doc: str, seq: str, least: int = 64, most: int = 20) -> DataFrame:
    """images (doc, seq, label, sha1, width, height, text) with `used`: the first of equal bytes, large enough, with text,
    and among the first `most` such ones."""
    first = F.row_number().over(Window.partitionBy(doc, "sha1").orderBy(seq)) == 1
    good = F.col("first") & (F.least("width", "height") >= least) & F.coalesce(~F.trim("text").isin(*EMPTY_OCR), F.lit(False))
    marked = images.withColumn("first", first).withColumn("good", F.coalesce(good, F.lit(False)))
    so_far = F.sum(F.col("good").cast("int")).over(Window.partitionBy(doc).orderBy(seq))
    return marked.withColumn("used", F.col("good") & (so_far <= most)).drop("first", "good")


def image_stats(marked: DataFrame, doc: str) -> DataFrame:
    return marked.groupBy(doc).agg(F.count(F.lit(1)).alias("images_found"), F.count_if("used").alias("images_ocred"), F.count_if(~F.col("used")).alias("images_skipped"))


def image_section(marked: DataFrame, doc: str, seq: str) -> DataFrame:
    """(doc, section): texts of used images under their labels."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.concat(F.lit("### "), F.col("label"), F.lit("\n\n"), F.trim("text")).alias("t"))))
    return marked.where("used").groupBy(doc).agg(F.concat(F.lit("## Embedded image text\n\n"), F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n")).alias("section"))


def restored(markdown: Column, formulas: Column, block: bool) -> Column:
    """Markers `XMATHI000000X` (`XMATHB...` for blocks) replaced by formulas[n]; by nothing where it is missing or empty."""
    letter = "B" if block else "I"
    parts = F.split(markdown, f"(?=XMATH{letter}[0-9]{{6}}X)")
    mark = f"^XMATH{letter}([0-9]{{6}})X"
    shown = (lambda f: F.concat(F.lit("\n\n```math\n"), f, F.lit("\n```\n\n"))) if block else (lambda f: F.concat(F.lit("$`"), f, F.lit("`$")))

    def one(p):
        f = F.try_element_at(formulas, F.regexp_extract(p, mark, 1).cast("int") + 1)
        return F.when(p.rlike(mark), F.concat(F.when(F.length(f) > 0, shown(f)).otherwise(""), F.regexp_replace(p, mark, ""))).otherwise(p)

    return F.array_join(F.transform(parts, one), "")


def equation_stats(markdown: Column, inline: Column, block: Column) -> Column:
    found = lambda letter: F.regexp_count(markdown, F.lit(f"XMATH{letter}[0-9]{{6}}X")).cast("long")
    out = []
    for name, letter, have in (("inline", "I", inline), ("block", "B", block)):
        n = F.size(have).cast("long")
        out += [F.lit(f"source_{name}"), n, F.lit(f"found_{name}"), found(letter), F.lit(f"missing_{name}"), n - found(letter)]
    return F.create_map(*out)


def pipe_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.coalesce(c.cast("string"), F.lit(""))), " | "), F.lit(" |"))


def pipe_table(columns: Column, rows: Column) -> Column:
    rule = F.concat(F.lit("| "), F.array_join(F.transform(columns, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(pipe_row(columns), rule), F.transform(rows, pipe_row)), "\n")


def capped_rows(rows: Column, cap: int) -> Column:
    return F.struct(F.slice(rows, 1, cap).alias("rows"), (F.size(rows) > cap).alias("truncated"))


def sampled(files: DataFrame, per_group: int, group: str = "ext", order: str = "path") -> DataFrame:
    """The first `per_group` files of each group; tasks keep that many before the shuffle."""
    return files.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("__n") <= per_group).drop("__n")


def report(runs: DataFrame, errors: int = 3) -> DataFrame:
    """Per extension and in all (ext null): files, successes, mean time, readers and how often, and the first errors.

    runs: (seq, ext, ok, ms, parser, error). Counts are summed before they meet; of errors, tasks keep the first few."""
    base = runs.rollup("ext").agg(F.grouping("ext").alias("whole"), F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("ok"), F.round(F.avg("ms"), 4).alias("avg_ms"))
    counts = runs.rollup("ext", "parser").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    by_ext = counts.where("g = 0").select("ext", F.lit(0).alias("whole"), "parser", "n")
    in_all = runs.groupBy("parser").agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("string").alias("ext"), F.lit(1).alias("whole"), "parser", "n")
    shown = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("parser", "n"))), lambda r: F.concat(r["parser"], F.lit("="), r["n"].cast("string"))), ",")
    readers = by_ext.unionByName(in_all).groupBy("ext", "whole").agg(shown.alias("readers"))
    failed = runs.where(~F.col("ok"))
    first = lambda rows, *by: rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("seq"))).where(F.col("r") <= errors)
    some = first(failed.withColumn("whole", F.lit(0)), "ext", "whole").select("ext", "whole", "seq", "error")
    top = failed.orderBy("seq").limit(errors).select(F.lit(None).cast("string").alias("ext"), F.lit(1).alias("whole"), "seq", "error")
    listed = some.unionByName(top).groupBy("ext", "whole").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "error"))), lambda r: r["error"]), ";").alias("errors"))
    base, readers, listed = (d.withColumn("__k", F.coalesce("ext", F.lit(""))) for d in (base, readers, listed))
    keys = ["__k", "whole"]
    return base.join(readers.drop("ext"), keys, "left").join(listed.drop("ext"), keys, "left").select("ext", "n", "ok", "avg_ms", "readers", F.coalesce("errors", F.lit("")).alias("errors"))
