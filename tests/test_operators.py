import itertools
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docmill.conf import Settings
from docmill.functions import text as X
from docmill.operators import layout as G
from docmill.operators import pagetext
from docmill.operators import relational as R
from docmill.plans import pipeline
from docmill.sources import office, pdf
from docmill.sources.markup import html_to_markdown
from docmill.sources.plain import image_info, rtf_text

from . import fixtures


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first().c


def test_folds_equal_plain_restatements(spark):
    rng = random.Random(1)
    rows = [(i, sorted(round(rng.uniform(0, 600), 1) for _ in range(rng.randint(0, 25)))) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, xs array<double>")
    got = {r.i: r for r in df.select("i", G.clustered(F.col("xs"), 50.0).alias("c"), G.adaptive_gap(F.col("xs")).alias("g"), G.upper_median(F.col("xs")).alias("m")).collect()}
    for i, xs in rows:
        starts = []
        for x in xs:
            if not starts or x - starts[-1] > 50:
                starts.append(x)
        gaps = sorted(b - a for a, b in itertools.pairwise(xs) if b - a > 5)
        want = max(25, min(50, gaps[int(len(gaps) * 0.7)])) if len(gaps) >= 3 else 35
        assert got[i].c == starts and got[i].g == pytest.approx(want) and got[i].m == (xs[len(xs) // 2] if xs else None)


def test_stitching_equals_a_loop(spark):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice([".1", " .22 ", "", "  ", "word", " two words ", ".x", "3.1"]) for _ in range(rng.randint(1, 8))) for _ in range(300)]

    def loop(text):
        import re

        lines, out, i = text.split("\n"), [], 0
        while i < len(lines):
            if re.fullmatch(r"\.\d+", lines[i].strip()):
                j = next((k for k in range(i + 1, len(lines)) if lines[k].strip()), None)
                if j is not None:
                    out.append(f"{lines[i].strip()} {lines[j].strip()}")
                    i = j + 1
                    continue
            out.append(lines[i])
            i += 1
        return "\n".join(out)

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(X.stitched_numbering(F.col("t")).alias("s")).collect()] == [loop(t) for t in texts]


def words(page, rows, size=10.0, x=72.0, step=45.0, top=150.0):
    return [(1, page, k * 100 + i, t, x + i * step, x + i * step + step - 5, top + k * 14, size if k else size * 1.6) for k, row in enumerate(rows) for i, t in enumerate(row)]


def test_pdf_layout_of_forms_columns_and_running_lines(spark):
    schema = "doc_id long, page int, seq int, text string, x0 double, x1 double, top double, size double"
    table = [["Item", "Price", "Count"], ["nut", "1", "20"], ["bolt", "2", "30"], ["gear", "3", "40"], ["belt", "4", "50"]]
    left = [(1, 2, k * 10 + i, f"l{k}{i}", 50.0 + i * 40, 85.0 + i * 40, 150.0 + k * 14, 10.0) for k in range(20) for i in range(4)]
    right = [(1, 2, 1000 + k * 10 + i, f"r{k}{i}", 320.0 + i * 40, 355.0 + i * 40, 157.0 + k * 14, 10.0) for k in range(20) for i in range(4)]
    plain = words(3, [["Big", "heading", "here"], *[[f"word{k}{i}" for i in range(12)] for k in range(6)]], step=40)
    df = spark.createDataFrame([*words(1, table, 10.0, step=150.0), *left, *right, *plain], schema)
    kinds = {r.page: r.layout for r in G.classified(df).collect()}
    assert kinds == {1: "single", 2: "prose_multi", 3: "single"}
    pages = spark.createDataFrame([(1, p) for p in (1, 2, 3, 4)], "doc_id long, page int")
    r = G.pdf_markdown(df, pages).first()
    assert r.page_count == 4 and r.markdown.endswith("## Page 4")
    assert "| Item | Price | Count |\n| ---- | ----- | ----- |\n| nut  | 1     | 20    |" in r.markdown
    assert r.markdown.index("l190") < r.markdown.index("r00")
    assert "# Big heading here\nword00 word01" in r.markdown


def test_ratio_of_glyph_codes_of_texts_with_and_without_them(spark):
    def plain(t):
        """As it was counted word by word and line by line."""
        t = None if t is None else str(t)
        if t is None or len(t.strip()) < 50:
            return None if t is None else 0.0
        codes, words = len(re.findall(r"\(cid:\d+\)", t)), [w for w in re.split(r"[ \t\n\x0B\f\r]+", t.strip()) if w]
        lines = [x for x in t.split("\n") if x.strip(" ")]
        return max(codes / max(1, len(words)), sum(bool(re.match(r"^\s*(?:\(cid:\d+\)\s*)+$", x)) for x in lines) / max(1, len(lines)))

    code, word = "(cid:12)", "word " * 12
    texts = [None, "", code, word, word + code, f"{code}\n{code} {code}\n \n{word}", f"\u00a0 {word}\u00a0{code}", "\n".join([code] * 9), word + "(cid:x)", f"{word}\n\t\n{code}x", " " * 60 + code]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.g for r in df.select("i", X.garbage_ratio(F.col("t")).alias("g")).orderBy("i").collect()] == [plain(t) for t in texts]


def test_trimmed_texts_are_stripped_ones(spark):
    spaces = [chr(c) for c in range(0x3005) if chr(c).isspace()] + ["\u200b", "\ufeff", "\x00", "é", "猫", "𝔸"]
    texts = [None, "", *spaces, *(f"{c} a{c}b {c}{d}" for c, d in itertools.pairwise(spaces)), "".join(spaces)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(X.strip(F.col("t")).alias("a"), X.trimmed(F.col("t")).alias("b"))
    assert all(r.a == r.b for r in df.collect()) and df.where("a = ''").count() > 20


def by_steps(words, pages, crop):
    """What pdf_markdown() gives, step by step over rows."""
    words = G.with_width(words)
    used, body = G.cropped(words) if crop else words, G.body_size(words)
    kinds = G.classified(used).localCheckpoint()
    columns = G.joined_lines(G.prose(G.in_strips(used, kinds), body, "strip"), "strip")
    rest = used.join(kinds.where("layout = 'prose_multi'"), ["doc_id", "page"], "left_anti")
    forms = G.form_tables(rest).localCheckpoint()
    plain = G.joined_lines(G.prose(rest.join(forms, ["doc_id", "page"], "left_anti"), body))
    found = pages.join(columns.unionByName(forms).unionByName(plain), ["doc_id", "page"], "left").withColumn("text", F.coalesce("text", F.lit(""))).localCheckpoint()
    raw = found.groupBy("doc_id").agg(X.garbage_ratio(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda r: r["text"]), "\n")).alias("garbage"))
    return G.joined_pages(G.without_running_lines(found.withColumn("text", X.cleaned(F.col("text"))))).join(raw, "doc_id")


def odd_words():
    """Pages of grids, two columns and scattered words, with running lines, glyph codes, numbering and letters of many sizes."""
    r, rows = random.Random(7), []
    texts = ["a", "item", "1.5", ".3", "(cid:7)", "x-", "naïve", "猫猫", "a|b", "12", "", "longer-word-than-others"]
    for d in range(60):
        width = r.choice([595.0, 612.0, 792.0, None])
        for page in r.sample(range(1, 30), r.choice([1, 2, 5, 9])):
            kind, step, size = r.choice(["grid", "grid", "two", "any", "one"]), r.choice([23, 45, 60, 110]), r.choice([7.5, 10.0, 10.0])
            mine = [("Running", 40.0, 90.0, 145.0, size), ("head", 95.0, 120.0, 145.0, size)] if d % 3 else []
            for k in range(1 if kind == "one" else r.choice([3, 12, 30])):
                for i in range(r.choice([3, 5, 5, 9])):
                    x = {"grid": 60 + i * step + r.choice([0, 0, 0.1, 21]), "two": (60, 330)[k % 2] + i * 24, "one": 70.0 + i}.get(kind, r.uniform(0, 600))
                    mine.append((r.choice(texts), float(x), x + r.choice([20.0, 20.3, 80.0]), r.choice([0, 150.0]) + k * 12.5 + r.choice([0, 0, 1.3, -2]), size * r.choice([1, 1, 1, 1.25, 1.6])))
            rows += [(d, page, n, *w[:4], w[4], width) for n, w in enumerate(mine)]
    return rows


def test_one_pass_over_words_equals_the_steps(spark):
    schema = "doc_id long, page int, seq int, text string, x0 double, x1 double, top double, size double, width double"
    rows = odd_words()
    pages = spark.createDataFrame([(d, p) for d in range(61) for p in range(1, 31)], "doc_id long, page int")
    words = spark.createDataFrame(rows, schema).localCheckpoint()
    key = lambda r: r.doc_id
    for crop in (True, False):
        want = sorted(by_steps(words, pages, crop).collect(), key=key)
        assert sorted(G.pdf_markdown(words, pages, crop).collect(), key=key) == want
        assert any("| --" in r.markdown for r in want) and any("# " in r.markdown.replace("## Page", "") for r in want) and any(r.garbage for r in want)
    named = words.select("doc_id", "page").distinct()
    assert sorted(G.pdf_markdown(words).collect(), key=key) == sorted(by_steps(words, named, True).collect(), key=key)


def test_documents_from_batches_of_any_size(monkeypatch):
    names = ["doc_id", "page", "seq", "text", "x0", "x1", "top", "size", "width"]
    t = pa.table(dict(zip(names, map(list, zip(*odd_words(), strict=True)), strict=True)))
    whole = list(pagetext.of_documents(iter(t.to_batches()), None))
    want = [r for b in whole for r in b.to_pylist()]
    assert len(whole) == 1 and len(want) == 60
    monkeypatch.setattr(pagetext, "WORDS", 500)
    for size in (1, 97, 5000):
        parts = list(pagetext.of_documents(iter(t.to_batches(size)), None))
        assert [r for b in parts for r in b.to_pylist()] == want and (len(parts) > 5 or size == 5000)


def test_pages_have_their_own_width(spark):
    schema = "doc_id long, page int, seq int, text string, x0 double, x1 double, top double, size double, width double"
    rows = [(d, 1, k * 100 + i, f"w{k}{i}", 72.0 + i * 60, 110.0 + i * 60, 150.0 + k * 14, 10.0, w) for d, w in ((1, 595.0), (2, 612.0), (3, 792.0), (4, 20.0)) for k in range(3) for i in range(12)]
    df = spark.createDataFrame(rows, schema)
    kept = {r.doc_id: r.n for r in G.cropped(df).groupBy("doc_id").agg(F.countDistinct("x0").alias("n")).collect()}
    assert kept == {1: 8, 2: 8, 3: 11, 4: 12}
    flags = {(r.doc_id, r.has_left, r.has_right) for r in G.line_flags(df.where("seq % 100 = 4")).collect()}
    assert flags == {(1, False, True), (2, False, True), (3, True, False), (4, False, True)}


LANGUAGES = {
    "en": "The weather is fine and the dog that was asleep for hours is now out with us.", "de": "Die Katze ist nicht der Hund, und das Haus von nebenan ist für ein Kind.",
    "fr": "Le chat est dans la maison et les enfants jouent sur le tapis pour une heure.", "es": "El perro de los vecinos que se acuesta por las tardes con una manta.",
    "it": "Il gatto che dorme non sono io, ma anche gli altri della casa per un po'.", "pt": "O menino que não come mais com os amigos em casa dos pais para uma festa.",
    "nl": "Het is niet zo dat een kat van de buren op zijn stoel wordt gezien.", "sv": "Det är inte så att alla som bor här har en katt och en hund med sig.",
    "pl": "To nie jest tak, że kot się nudzi na dachu oraz dla zabawy skacze.", "cs": "Kočka je na střeše a také jsou tam psi, které byl vidět jako pro děti.",
    "ru": "Кот не спит на крыше, и это как раз то, что нужно для дома.", "uk": "Кіт не спить на даху, і це те, що є як для дому та від саду.",
    "tr": "Bu kedi çok güzel ve bir köpek gibi daha iyi olan bir ev için.", "vi": "Con mèo của tôi là một con vật không có trong nhà và được cho ăn.",
    "ja": "猫は屋根の上で眠っています。そして犬は庭にいます。とても静かな日です。", "zh-cn": "猫在屋顶上睡觉，狗在花园里玩耍，这是一个非常安静的日子，天气很好。", "ko": "고양이는 지붕 위에서 자고 있고 개는 정원에 있습니다.",
    "el": "Η γάτα κοιμάται στη στέγη και ο σκύλος είναι στον κήπο.", "ar": "القطة نائمة على السطح والكلب في الحديقة اليوم.", "he": "החתול ישן על הגג והכלב נמצא בגינה היום.", "th": "แมวนอนอยู่บนหลังคาและสุนัขอยู่ในสวนวันนี้", "hi": "बिल्ली छत पर सो रही है और कुत्ता बगीचे में है।",
}


def test_languages(spark):
    from docmill.functions import language as L

    rows = [*LANGUAGES.items(), (None, "too short"), (None, "12345 67890 12345 67890"), ("en", "The word is 猫 and that is the only one of its kind for now, with thanks.")]
    got = [r.l for r in spark.createDataFrame(rows, "want string, t string").select(L.language(F.col("t")).alias("l")).collect()]
    assert got == [w for w, _ in rows]


def test_running_lines_go(spark):
    pages = spark.createDataFrame([(1, p, f"  Journal \nbody {p}\n{p}\nfooter") for p in range(1, 5)] + [(2, 1, "Journal\nx")], "doc_id long, page int, text string")
    got = {(r.doc_id, r.page): r.text for r in G.without_running_lines(pages).collect()}
    assert got == {**{(1, p): f"body {p}\n{p}" for p in range(1, 5)}, (2, 1): "Journal\nx"}


def test_gates(spark):
    cid = "(cid:12) " * 40
    assert one(spark, X.garbage_ratio(F.lit(cid))) > 0.3
    assert one(spark, X.garbage_ratio(F.lit("On 2024-01-15 the meeting (see notes) began, and went on for three hours in all."))) < 0.05
    page = lambda n: "## Page 1\n\n" + "x" * n
    needs = lambda n, creator, size: one(spark, X.needs_ocr(F.lit(page(n)), F.lit(1), F.lit(creator), F.lit(size)))
    assert needs(10, None, 100) and needs(150, None, 600_000) and not needs(2000, None, 600_000) and not needs(150, "Microsoft Word", 600_000)


def test_dates_and_clean_values(spark):
    for text, want in (("D:20240115093000+05'00'", "2024-01-15T09:30:00"), ("D:2024011509", "2024-01-15T09"), ("D:202401", "2024-01"), ("garbage", ""), (None, "")):
        assert one(spark, X.pdf_date(F.lit(text).cast("string"))) == want
    assert one(spark, X.size_label(F.lit(1023))) == "1023 bytes" and one(spark, X.size_label(F.lit(2048))) == "2 KB"


def test_equations_are_restored(spark):
    text = F.lit("a XMATHI000000X b XMATHI000005X c XMATHB000000X d")
    inline = R.restored(text, F.array(F.lit("x^2")), False)
    assert one(spark, R.restored(inline, F.array(F.lit("y")), True)) == "a $`x^2`$ b  c \n\n```math\ny\n```\n\n d"
    stats = one(spark, R.equation_stats(text, F.array(F.lit("x")), F.array(F.lit("y"))))
    assert stats == {"source_inline": 1, "found_inline": 2, "missing_inline": -1, "source_block": 1, "found_block": 1, "missing_block": 0}


@pytest.mark.parametrize(("math", "want"), [
    ("<m:rad><m:deg/><m:e><m:r><m:t>x</m:t></m:r></m:e></m:rad>", "\\sqrt{x}"),
    ('<m:nary><m:naryPr><m:chr m:val="∑"/></m:naryPr><m:sub><m:r><m:t>i</m:t></m:r></m:sub><m:sup><m:r><m:t>n</m:t></m:r></m:sup><m:e><m:r><m:t>i</m:t></m:r></m:e></m:nary>', "\\sum_{i}^{n}{i}"),
    ('<m:d><m:dPr><m:begChr m:val="["/><m:endChr m:val="]"/></m:dPr><m:e><m:r><m:t>a</m:t></m:r></m:e></m:d>', "\\left[a\\right]"),
    ("<m:m><m:mr><m:e><m:r><m:t>1</m:t></m:r></m:e><m:e><m:r><m:t>2</m:t></m:r></m:e></m:mr></m:m>", "\\begin{matrix}1 & 2\\end{matrix}"),
])
def test_office_math(math, want):
    assert office.latex(office.parsed(f'<m:oMath xmlns:m="http://m">{math}</m:oMath>'.encode())) == want


def test_xml_with_entities_is_refused():
    bomb = b'<!DOCTYPE a [<!ENTITY b "x"><!ENTITY c "&b;&b;">]><a>&c;</a>'
    with pytest.raises(Exception, match="document type"):
        office.parsed(bomb)


def test_html():
    text, title = html_to_markdown("<html><head><title>T &amp; U</title><style>p{}</style></head><body><h2>A <i>b</i></h2><ol><li>x<ul><li>y</ul><li>z</ol><table><tr><th>k<th>v<tr><td>1<td>a|b</table><pre>  code\n</pre><b>open <a href='/u'>l</a>")
    assert title == "T & U"
    assert text.startswith("## A *b*\n\n") and "1. x\n\n  - y" in text.replace("\n\n\n", "\n\n") and "| k | v |\n| --- | --- |\n| 1 | a\\|b |" in text
    assert "```\n  code\n\n```" in text and text.endswith("open [l](/u)")


def test_pdf_reader_details():
    stream = b"BT /F1 10 Tf 1 0 0 1 72 700 Tm [(Hel) -50 (lo) -400 (there)] TJ 0 -20 Td (next \\050line\\051) Tj ET"
    found = pdf.pdf_words(fixtures.pdf(body=[stream]))
    assert [w["text"] for w in found["words"]] == ["Hello", "there", "next", "(line)"]
    assert pdf._lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == b"-----A---B"
    with pytest.raises(Exception, match="encrypted"):
        pdf.pdf_words(fixtures.pdf(encrypted=True))


def test_image_headers():
    import struct

    assert image_info(fixtures.png(7, 9)) == ("PNG", 7, 9)
    assert image_info(b"GIF89a" + struct.pack("<HH", 3, 4)) == ("GIF", 3, 4)
    assert image_info(b"BM" + bytes(16) + struct.pack("<ii", 5, -6)) == ("BMP", 5, 6)
    assert image_info(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 8, 9)) == ("JPEG", 9, 8)
    assert image_info(b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHIHxx", 256, 3, 1, 11) + struct.pack("<HHII", 257, 4, 1, 12)) == ("TIFF", 11, 12)
    assert image_info(b"RIFF0000WEBPVP8X" + bytes(8) + bytes([9, 0, 0, 4, 0, 0])) == ("WEBP", 10, 5)
    assert rtf_text(rb"{\rtf1 hello world}") == "hello world"


def test_settings_come_from_the_session(spark):
    spark.conf.set("docmill.max_file_mb", "7")
    spark.conf.set("docmill.verify_mime", "true")
    s = Settings.of(spark)
    spark.conf.unset("docmill.max_file_mb")
    spark.conf.unset("docmill.verify_mime")
    assert s.max_file_mb == 7 and s.verify_mime and Settings(gemini_key="k").ocr_engine() == "gemini" and s.ocr_engine() == "tesseract"


def test_schema_of_results_is_stable(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    from docmill.sources import files

    got = pipeline.convert(files.scan(spark, str(tmp_path)), "structured")
    assert got.columns == ["doc_id", "filename", "ext", "bytes", "mode", "parser", "markdown", "structured", "metadata", "stats", "status", "error_kind", "error"]
