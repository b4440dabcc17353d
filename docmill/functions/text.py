"""Text operations as Column expressions; none of them starts a Python worker."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"\t\n\x0B\f\r \x1C-\x1F\x85\xA0  -     　"


def extension(name: Column) -> Column:
    """Last suffix with its dot in lower case, or an empty string."""
    return F.lower(F.regexp_extract(name, r"[^./](\.[^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-1))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{_SPACE}]+|[{_SPACE}]+\z", "")


#: What strip() takes off, character by character.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{_SPACE}]", c))


def trimmed(text: Column) -> Column:
    """strip() without an expression that looks at every character; for many short texts."""
    return F.btrim(text, F.lit(_SPACES))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 without its mark where valid, else Latin-1."""
    return F.when(F.is_valid_utf8(content), F.regexp_replace(content.cast("string"), r"^﻿", "")).otherwise(F.decode(content, "ISO-8859-1"))


def normalised_markdown(text: Column) -> Column:
    """No white space at line ends, no more than one empty line in a row."""
    lines = F.regexp_replace(text, rf"(?m)[{_SPACE}&&[^\n]]+$", "")
    return collapsed(F.regexp_replace(lines, r"\r\n", "\n"))


def collapsed(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def without_codes(text: Column) -> Column:
    return F.regexp_replace(text, r"\(cid:\d+\)", "")


def joined_hyphens(text: Column) -> Column:
    return F.regexp_replace(text, r"([a-z])-\n([a-z])", "$1$2")


def cleaned(text: Column) -> Column:
    """Glyph codes go first, then broken words are joined, then empty lines collapse."""
    return collapsed(joined_hyphens(without_codes(text)))


def stitched_numbering(text: Column) -> Column:
    """A line that is only `.N` is joined with the next line that is not blank."""
    return F.regexp_replace(text, r"(?m)^[ \t]*(\.\d+)[ \t]*\n(?:[ \t]*\n)*[ \t]*(\S(?:[^\n]*\S)?)[ \t]*$", "$1 $2")


def code_line(line: Column) -> Column:
    return line.rlike(r"^\s*(?:\(cid:\d+\)\s*)+$")


def pdf_date(text: Column) -> Column:
    """D:YYYYMMDDHHmmSS as YYYY-MM-DDTHH:MM:SS, as far as it goes; offsets are left out; an empty string for others."""
    part = lambda i: F.regexp_extract(text, r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?", i)
    y, mo, d, h, mi, s = (part(i) for i in range(1, 7))
    day = F.concat(y, F.when(mo != "", F.concat(F.lit("-"), mo)).otherwise(""), F.when((mo != "") & (d != ""), F.concat(F.lit("-"), d)).otherwise(""))
    time = F.when((d != "") & (h != ""), F.concat(F.lit("T"), h, F.when(mi != "", F.concat(F.lit(":"), mi)).otherwise(""), F.when(s != "", F.concat(F.lit(":"), s)).otherwise(""))).otherwise("")
    return F.coalesce(F.when(y == "", "").otherwise(F.concat(day, time)), F.lit(""))


def size_label(size: Column) -> Column:
    """Whole KB from 1024 bytes on, else bytes."""
    return F.when(size >= 1024, F.concat((F.floor(size / 1024)).cast("long").cast("string"), F.lit(" KB"))).otherwise(F.concat(size.cast("long").cast("string"), F.lit(" bytes")))


def fenced(text: Column, language: str = "json") -> Column:
    return F.concat(F.lit(f"```{language}\n"), text, F.lit("\n```"))


def searchable(summary: Column, elements: Column, kind: Column, text: Column) -> Column:
    """Parts of an image's text that are there, an empty line between them."""
    some = lambda label, c: F.when(F.length(c) > 0, F.concat(F.lit(label), c))
    return F.concat_ws("\n\n", F.nullif(summary, F.lit("")), some("Visual elements: ", elements), some("Document type: ", kind), some("Extracted text:\n", text))


def image_heading(name: Column, body: Column) -> Column:
    return F.concat(F.lit("# Image: "), name, F.lit("\n\n"), body)


def heading_shaped(line: Column) -> Column:
    digits = F.regexp_replace(line, "[. ]", "")
    return F.length(line).between(4, 150) & ~line.contains("|") & ~digits.rlike(r"^\d+$")


def heading_mark(ratio: Column) -> Column:
    return F.when(ratio >= 1.5, "# ").when(ratio >= 1.25, "## ").otherwise("")


def language_sample(text: Column, chars: int = 2000) -> Column:
    """What a language is told from, null if it is too short."""
    sample = F.substring(strip(text), 1, chars)
    return F.when(F.length(sample) >= 20, sample)


def garbage_ratio(text: Column) -> Column:
    """Glyph codes per word, or lines of codes per line, whichever is more; 0 below 50 characters. Where no code is, nothing is counted."""
    ratio = F.element_at(F.transform(F.array(trimmed(text)), lambda t: _garbage(text, t)), F.lit(1))
    return F.when(~F.contains(text, F.lit("(cid:")), F.lit(0.0)).otherwise(ratio)


def _garbage(text: Column, stripped: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)
    codes = F.regexp_count(text, F.lit(r"\(cid:\d+\)"))
    of_words = codes / F.greatest(F.lit(1), F.regexp_count(stripped, F.lit(r"\S+")))
    of_lines = F.element_at(F.transform(F.array(lines), lambda found: F.size(F.filter(found, lambda x: F.contains(x, F.lit("(cid:")) & code_line(x))) / F.greatest(F.lit(1), F.size(found))), F.lit(1))
    return F.when(F.length(stripped) < 50, F.lit(0.0)).otherwise(F.greatest(of_words, of_lines))


#: Creators whose files have a text layer.
DIGITAL_CREATORS = ("word", "latex", "tex", "indesign", "libreoffice")


def needs_ocr(markdown: Column, pages: Column, creator: Column, size: Column, least: int = 100, least_heavy: int = 300, heavy: int = 500_000) -> Column:
    """Too little text per page; page headings do not count."""
    headings = F.aggregate(F.regexp_extract_all(markdown, F.lit(r"## Page \d+"), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    n = F.greatest(F.lit(1), pages)
    density = (F.length(markdown) - headings) / n
    digital = F.coalesce(F.lower(creator).rlike("|".join(DIGITAL_CREATORS)), F.lit(False))
    return (density < least) | (~digital & (size / n > heavy) & (density < least_heavy))


def mbox_signed(content: Column) -> Column:
    """Whether bytes look like a mailbox."""
    head = F.substring(content, 1, 256)
    return (F.length(content) > 0) & (F.startswith(head, F.lit(b"From ")) | F.contains(head, F.lit(b"\nFrom ")))


def sniffed(content: Column) -> Column:
    """Extension that the first bytes stand for, or null."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.when(head.startswith("255044462D"), ".pdf").when(head.startswith("89504E470D0A1A0A"), ".png").when(head.startswith("FFD8FF"), ".jpg")
    out = out.when(head.startswith("474946383761") | head.startswith("474946383961"), ".gif").when(head.startswith("49492A00") | head.startswith("4D4D002A"), ".tif")
    return out.when(head.startswith("424D"), ".bmp").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), ".webp")


def rerouted(ext: Column, content: Column) -> Column:
    """The extension, unless the content is of another family (pdf or image); then the content's."""
    from docmill.registry import in_families

    found = sniffed(content)
    own, real = in_families(ext), in_families(found)
    return F.when(real.isNotNull() & ~real.eqNullSafe(own), found).otherwise(ext)


def drop_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))
