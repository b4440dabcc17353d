"""Page layout over a table of words (schema.WORDS): lines, columns, tables, headings, running lines.

Everything is keyed by document and page (or by document), so one exchange on doc_id serves whole chains of these steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions import text as X
from docmill.plans.store import written

PAGE = ("doc_id", "page")


def y_layout(top: Column) -> Column:
    """Bands of 4 points, cut off towards zero."""
    return (top / 4).cast("int") * 4


def y_prose(top: Column) -> Column:
    """Bands of 3 points around multiples of 3; halves go to the even one."""
    return (F.bround(top / 3) * 3).cast("int")


def y_form(top: Column) -> Column:
    return F.bround(top / 5) * 5


#: Width of a page that does not say its own, in points.
WIDTH = 612.0


def with_width(words: DataFrame) -> DataFrame:
    """words whose `width` is that of their page, WIDTH where it is not known."""
    return words.withColumn("width", F.coalesce("width", F.lit(WIDTH)) if "width" in words.columns else F.lit(WIDTH))


def cropped(words: DataFrame, right: float = 30.0, top: float = 140.0) -> DataFrame:
    """Without the right margin, and without the head of the first page; pages that are no wider than the margin are left whole."""
    words = with_width(words)
    return words.where((F.col("width") <= right) | ((F.col("x1") <= F.col("width") - right) & ((F.col("page") > 1) | (F.col("top") >= top))))


def lines(words: DataFrame, y: Column, *more: str) -> DataFrame:
    """A row per page and band: its words from left to right (in reading order where they start at the same place)."""
    row = F.struct("x0", "seq", "text", "x1", "size")
    return words.groupBy(*PAGE, *more, y.alias("y")).agg(F.sort_array(F.collect_list(row)).alias("words"))


def line_text(words: Column = None) -> Column:
    return F.array_join(F.transform(F.col("words") if words is None else words, lambda w: w["text"]), " ")


def upper_median(values: Column) -> Column:
    """The middle one of an array, the upper of two; null for an empty one."""
    return F.try_element_at(F.sort_array(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def body_size(words: DataFrame, pages: int = 20, default: float = 10.0) -> DataFrame:
    """(doc_id, body): the upper median of letter sizes on the first pages."""
    some = words.where(F.col("page") <= pages).groupBy("doc_id").agg(F.collect_list("size").alias("sizes"))
    return some.select("doc_id", F.coalesce(upper_median(F.col("sizes")), F.lit(default)).alias("body"))


def line_flags(words: DataFrame, *more: Column) -> DataFrame:
    left = F.col("x0") < F.col("width") / 2
    return with_width(words).groupBy(*PAGE, y_layout(F.col("top")).alias("y")).agg(F.min("x0").alias("x_min"), F.bool_or(left).alias("has_left"), F.bool_or(~left).alias("has_right"), *more)


def classified(words: DataFrame) -> DataFrame:
    """(doc_id, page, layout, divider): single, glossary or prose_multi."""
    x, width = F.col("x_min"), F.col("width")
    middle = F.when((x > width * 0.35) & (x < width * 0.60), x)
    centres = F.collect_list((F.col("x0") + F.col("x1")) / 2).alias("centres")
    p = line_flags(words, F.max("width").alias("width"), F.count(F.lit(1)).alias("n"), centres).groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("n").alias("n_words"), F.flatten(F.collect_list("centres")).alias("centres"), F.count(middle).alias("n_middle"), upper_median(F.collect_list(middle)).alias("divider"),
        F.count_if(F.col("has_right") & ~F.col("has_left")).alias("right_only"), F.count_if(F.col("has_left") & ~F.col("has_right")).alias("left_only"))
    p = p.withColumn("straddlers", F.size(F.filter("centres", lambda c: F.abs(c - F.col("divider")) < 10)))
    right, left = F.col("right_only") / F.col("n_lines"), F.col("left_only") / F.col("n_lines")
    kind = F.when((F.col("n_words") < 30) | (F.col("n_lines") < 8) | (F.col("n_middle") < F.col("n_lines") * 0.15), "single")
    kind = kind.when((right >= 0.15) & (left < 0.05), "glossary")
    kind = kind.when((left >= 0.10) & (right >= 0.10) & (F.col("straddlers") / F.col("n_words") < 0.05), "prose_multi").otherwise("single")
    return p.select(*PAGE, kind.alias("layout"), F.when(kind != "single", F.col("divider")).alias("divider"))


def prose(words: DataFrame, body: DataFrame, *more: str) -> DataFrame:
    """A row per line with its text, marked as a heading where its letters are larger than the body's."""
    found = lines(words, y_prose(F.col("top")), *more).join(body, "doc_id", "left")
    mean = F.aggregate("words", F.lit(0.0), lambda a, w: a + w["size"]) / F.size("words")
    found = found.withColumn("text", line_text())
    mark = F.when(X.heading_shaped(F.col("text")), X.heading_mark(mean / F.coalesce(F.col("body"), F.lit(10.0)))).otherwise("")
    return found.withColumn("mark", mark).select(*PAGE, *more, "y", "mark", F.concat("mark", "text").alias("text"))


def joined_lines(found: DataFrame, *order: str) -> DataFrame:
    """Pages (doc_id, page, text) from lines, from top to bottom."""
    rows = F.sort_array(F.collect_list(F.struct(*order, "y", "text")))
    return found.groupBy(*PAGE).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


def in_strips(words: DataFrame, pages: DataFrame) -> DataFrame:
    """words of two-column pages with their strip, 0 left of the divider and 1 from there on, by their centres."""
    return words.join(pages.where("layout = 'prose_multi'").select(*PAGE, "divider"), list(PAGE)).withColumn("strip", (((F.col("x0") + F.col("x1")) / 2) >= F.col("divider")).cast("int"))


def clustered(sorted_values: Column, gap: Column | float) -> Column:
    """Starts of clusters of a sorted array: a value starts one if it is more than `gap` after the last start."""
    empty = F.array().cast("array<double>")
    fold = lambda g: F.aggregate(sorted_values, empty, lambda a, x: F.when((F.size(a) == 0) | (x - F.try_element_at(a, F.lit(-1)) > g), F.array_append(a, x)).otherwise(a))
    return let(gap, fold) if isinstance(gap, Column) else fold(gap)


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.try_element_at(F.transform(F.array(value), f), F.lit(1))


def adaptive_gap(sorted_values: Column, share: float = 0.70, digits: int | None = None) -> Column:
    """A tolerance from the gaps of a sorted array: that share of those above 5, from 25 to 50; 35 where there are under three.

    digits: gaps are rounded to so many first, so that the last bit of a difference does not say whether 5.00 is above 5."""
    pairs = F.transform(F.slice(sorted_values, F.lit(2), F.greatest(F.size(sorted_values) - 1, F.lit(0))), lambda x, i: x - F.try_element_at(sorted_values, i + 1))
    if digits is not None:
        pairs = F.transform(pairs, lambda g: F.round(g, digits))
    gaps = F.sort_array(F.filter(pairs, lambda g: g > 5))
    at = F.try_element_at(gaps, (F.size(gaps) * share).cast("int") + 1)
    return F.when(F.size(gaps) >= 3, F.greatest(F.lit(25.0), F.least(F.lit(50.0), at))).otherwise(F.lit(35.0))


def column_of(x: Column, starts: Column, slack: float = 20.0) -> Column:
    """Index of the first column whose successor starts more than `slack` right of x, else of the last one."""
    right = F.array_position(F.transform(starts, lambda c, i: (i > 0) & (x < c - slack)), F.lit(True)).cast("int")
    return F.coalesce(F.nullif(right, F.lit(0)) - 2, F.size(starts) - 1)


def aligned_with(x: Column, starts: Column, band: float = 40.0) -> Column:
    """Index of the first column within `band` of x, or null."""
    return F.nullif(F.array_position(F.transform(starts, lambda c: F.abs(x - c) < band), F.lit(True)).cast("int"), F.lit(0)) - 1


def runs(rows: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """Rows where flag holds, with `run`, the same for neighbours without a gap (order counts up by one)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where(flag).withColumn("run", F.col("__n") - F.row_number().over(w)).drop("__n")


def form_columns(words: DataFrame) -> DataFrame:
    """A row per line of pages that look like forms: words, columns of the page, is_row (a table row).

    The columns of a page are found once, in one row per page, and meet its lines again."""
    found = lines(with_width(words), y_form(F.col("top")), "width")
    xs = F.transform("words", lambda w: w["x0"])
    wide = F.try_element_at("words", F.lit(-1))["x1"] - F.try_element_at("words", F.lit(1))["x0"]
    found = found.withColumn("text", line_text())
    found = found.withColumn("is_paragraph", (wide > F.col("width") * 0.55) & (F.length("text") > 60))
    groups = clustered(F.sort_array(xs), 50.0)
    mine = F.when(~F.col("is_paragraph") & (F.size("words") >= 3), let(groups, lambda g: F.when(F.size(g) >= 3, g)))
    of_pages = found.groupBy(*PAGE).agg(F.sort_array(F.flatten(F.collect_list(mine))).alias("xs"), F.max("width").alias("page_width")).where(F.size("xs") > 0)
    # An exploded array of one: what is below it is computed once.
    of_pages = of_pages.select(*PAGE, "page_width", F.explode(F.array(clustered(F.col("xs"), adaptive_gap(F.col("xs"))))).alias("columns"))
    n, span = F.size("columns"), F.try_element_at("columns", F.lit(-1)) - F.try_element_at("columns", F.lit(1))
    of_pages = of_pages.where(n > 1).where((span / n >= 30) & (n / (span / 72) <= 10) & (n <= F.greatest(F.lit(15), F.floor(F.lit(20) * F.col("page_width") / WIDTH))))
    found = found.drop("width").join(of_pages, list(PAGE))
    numbered = F.trim(F.try_element_at("words", F.lit(1))["text"]).rlike(r"^\.\d+$")
    on = F.array_distinct(F.filter(F.transform("words", lambda x: aligned_with(x["x0"], F.col("columns"))), lambda i: i.isNotNull()))
    found = found.select(*PAGE, "y", "words", "text", "columns", F.explode(F.array(~F.col("is_paragraph") & ~numbered & (F.size(on) >= 2))).alias("is_row"))
    return found.withColumn("row_share", F.avg(F.col("is_row").cast("double")).over(Window.partitionBy(*PAGE))).where("row_share >= 0.2").drop("row_share")


def cells(words: Column, starts: Column) -> Column:
    """Texts of a row's words by column, joined by spaces."""
    tagged = F.transform(words, lambda w: F.struct(column_of(w["x0"], starts).alias("c"), w["text"].alias("t")))
    return let(tagged, lambda all_: F.transform(F.sequence(F.lit(0), F.size(starts) - 1), lambda k: F.array_join(F.transform(F.filter(all_, lambda s: s["c"] == k), lambda s: s["t"]), " ")))


def padded_row(row: Column, widths: Column) -> Column:
    pad = lambda c, n: F.when(F.length(c) >= n, c).otherwise(F.rpad(c, n, " "))
    return F.concat(F.lit("| "), F.array_join(F.zip_with(row, widths, pad), " | "), F.lit(" |"))


def form_tables(words: DataFrame, least_rows: int = 3) -> DataFrame:
    """Pages (doc_id, page, text) of forms, their table regions as pipe tables; pages whose longest run of table lines is
    below `least_rows` are left out. A region is one row while its widths are found and it is rendered."""
    w = Window.partitionBy(*PAGE).orderBy("y")
    found = written(form_columns(words), "forms").withColumn("n", F.row_number().over(w)).withColumn("m", F.sum(F.col("is_row").cast("int")).over(w))
    row = F.struct("y", cells(F.col("words"), F.col("columns")).alias("cells"))
    rows = F.transform(F.sort_array(F.collect_list(row)), lambda r: r["cells"])
    regions = found.where("is_row").groupBy(*PAGE, (F.col("n") - F.col("m")).alias("region")).agg(F.min("y").alias("y"), rows.alias("rows"))
    widest = lambda k: F.greatest(F.lit(3), F.array_max(F.transform("rows", lambda r: F.length(F.get(r, k)))))
    regions = regions.select(*PAGE, "y", "rows", F.explode(F.array(F.transform(F.sequence(F.lit(0), F.size(F.get("rows", F.lit(0))) - 1), widest))).alias("widths"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform("widths", lambda n: F.repeat(F.lit("-"), n)), " | "), F.lit(" |"))
    shown = F.transform("rows", lambda r: padded_row(r, F.col("widths")))
    n = F.size("rows")
    table = F.array_join(F.concat(F.slice(shown, 1, 1), F.array(rule), F.slice(shown, F.lit(2), F.greatest(n - 1, F.lit(0)))), "\n")
    # The rule under the head cuts the head off from the rows below it.
    tables = regions.select(*PAGE, "y", F.when(n > 1, n - 1).otherwise(n).alias("run"), table.alias("text"))
    others = found.where("NOT is_row").select(*PAGE, "y", F.lit(0).alias("run"), "text")
    page = tables.unionByName(others).groupBy(*PAGE).agg(F.max("run").alias("rows"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "text"))), lambda s: s["text"]), "\n").alias("text"))
    return page.where(F.col("rows") >= least_rows).select(*PAGE, "text")


def running_lines(pages: DataFrame, doc: str = "doc_id", text: str = "text", least: int = 3) -> DataFrame:
    """(doc, line): first and last lines that come back on at least a third of the pages, and on `least`; under 200 characters."""
    found = F.filter(F.transform(F.split(text, "\n"), X.strip), lambda x: x != "")
    ends = pages.select(doc, found.alias("l")).withColumn("n_pages", F.count(F.lit(1)).over(Window.partitionBy(doc)))
    ends = ends.where((F.size("l") > 0) & (F.col("n_pages") >= least))
    both = ends.select(doc, "n_pages", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.try_element_at("l", F.lit(1)).alias("line")), F.struct(F.lit(1).alias("end"), F.try_element_at("l", F.lit(-1)).alias("line")))).alias("e"))
    counts = both.groupBy(doc, "e.end", "e.line").agg(F.count(F.lit(1)).alias("n"), F.first("n_pages").alias("n_pages"))
    return counts.where((F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("n_pages") / 3))) & (F.length("line") < 200)).select(doc, "line").distinct()


def without_running_lines(pages: DataFrame, doc: str = "doc_id", text: str = "text", least: int = 3) -> DataFrame:
    """pages with running lines taken off their tops and bottoms."""
    repeated = running_lines(pages, doc, text, least).groupBy(doc).agg(F.collect_set("line").alias("__repeated"))
    joined = pages.join(repeated, doc, "left")
    rows = F.split(text, "\n")
    keep = F.transform(rows, lambda x: ~F.array_contains("__repeated", X.strip(x)))
    first = F.array_position(keep, F.lit(True))
    last = F.size(rows) + 1 - F.array_position(F.reverse(keep), F.lit(True))
    body = F.when(first == 0, "").otherwise(F.array_join(F.slice(rows, first.cast("int"), (last - first + 1).cast("int")), "\n"))
    return joined.withColumn(text, F.when(F.col("__repeated").isNull(), F.col(text)).otherwise(body)).drop("__repeated")


def page_block(page: Column, text: Column) -> Column:
    """A page under its heading."""
    return F.concat(F.lit("## Page "), page.cast("string"), F.when(F.length(F.trim(text)) > 0, F.concat(F.lit("\n\n"), X.stitched_numbering(text))).otherwise(""))


def joined_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, page_count, markdown): pages under their headings; numbering is stitched within a page, never across one."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), page_block(F.col(page), F.col(text)).alias("t"))))
    return pages.groupBy(doc).agg(F.count(F.lit(1)).alias("page_count"), X.collapsed(F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n")).alias("markdown"))


def page_texts(words: DataFrame, crop: tuple[float, float] | None = None, together: bool = False) -> DataFrame:
    """(doc_id, pages): texts of a document's pages (page, text) in order, by the steps above in one pass over its words.

    crop: right margin and head of the first page. together: words of a document already follow each other in one partition, as
    those exploded from one row do, and are not moved; else they are dealt out by document. A document's words are held at once."""
    from docmill.operators import pagetext

    words = with_width(words)
    if not together:
        words = words.repartition("doc_id").sortWithinPartitions("doc_id", "page")
    schema = T.StructType([words.schema["doc_id"], T.StructField("pages", T.ArrayType(T.StructType([T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType())])))])
    return words.select("doc_id", "page", "seq", "text", "x0", "x1", "top", "size", "width").mapInArrow(lambda batches: pagetext.of_documents(batches, crop), schema)


def stripped_pages(texts: Column, least: int = 3) -> Column:
    """What without_running_lines does, for a document's pages in an array."""
    rows = lambda t: F.filter(F.transform(F.split(t, "\n"), lambda x: X.trimmed(x)), lambda x: x != "")
    threshold = F.greatest(F.lit(least), F.floor(F.size(texts) / 3)).cast("int")
    # In order, a line that is there often enough is that far on still the same.
    often = lambda lines: let(F.sort_array(F.filter(lines, lambda x: x.isNotNull() & (F.length(x) < 200))), lambda s: F.filter(s, lambda x, i: F.get(s, i + threshold - 1) == x))
    ends = lambda found: F.array_union(often(F.transform(found, lambda x: F.get(x, F.lit(0)))), often(F.transform(found, lambda x: F.try_element_at(x, F.lit(-1)))))

    def body(text: Column, repeated: Column) -> Column:
        def kept(both: Column) -> Column:
            first = F.array_position(both["keep"], F.lit(True))
            last = F.size(both["keep"]) + 1 - F.array_position(F.reverse(both["keep"]), F.lit(True))
            return F.when(first == 0, "").otherwise(F.array_join(F.slice(both["rows"], first.cast("int"), (last - first + 1).cast("int")), "\n"))

        return let(F.split(text, "\n"), lambda r: let(F.struct(r.alias("rows"), F.transform(r, lambda x: ~F.array_contains(repeated, X.trimmed(x))).alias("keep")), kept))

    clean = let(ends(F.transform(texts, rows)), lambda repeated: F.when(F.size(repeated) == 0, texts).otherwise(F.transform(texts, lambda t: body(t, repeated))))
    return F.when(F.size(texts) < least, texts).otherwise(clean)


def pdf_markdown(words: DataFrame, pages: DataFrame | None = None, crop: bool = True, right: float = 30.0, top: float = 140.0, together: bool = False) -> DataFrame:
    """Words to documents: (doc_id, page_count, markdown, garbage). pages (doc_id, page) names the documents, and also pages
    without words; else those with words are returned. together: as page_texts() has it; words are then not moved at all.

    Only texts of pages are written, once. A document is one row from its words on, so that its cleaning, running lines and
    numbering need no exchange."""
    found = written(page_texts(words, (right, top) if crop else None, together), "pages")
    if pages is not None:
        named = pages.groupBy("doc_id").agg(F.collect_set("page").alias("named")).join(found, "doc_id", "left")
        have = F.coalesce("pages", F.array().cast(found.schema["pages"].dataType))
        listed = F.array_intersect(F.transform(have, lambda p: p["page"]), F.col("named"))
        have = F.when(F.size(listed) == F.size(have), have).otherwise(F.filter(have, lambda p: F.array_contains("named", p["page"])))
        empty = F.transform(F.array_except(F.col("named"), listed), lambda p: F.struct(p.cast("int").alias("page"), F.lit("").alias("text")))
        found = named.select("doc_id", F.sort_array(F.concat(have, empty)).alias("pages"))
    texts = F.transform("pages", lambda p: p["text"])
    clean = let(F.transform(texts, X.cleaned), lambda t: stripped_pages(t))
    # An exploded array of one: what is below it is computed once.
    garbage = let(F.array_join(texts, "\n"), lambda t: X.garbage_ratio(t))
    found = found.select("doc_id", F.transform("pages", lambda p: p["page"]).alias("n"), garbage.alias("garbage"), F.explode(F.array(clean)).alias("texts"))
    markdown = X.collapsed(F.array_join(F.zip_with("n", "texts", page_block), "\n\n"))
    return found.select("doc_id", F.size("n").cast("long").alias("page_count"), markdown.alias("markdown"), "garbage")
