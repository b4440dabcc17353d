"""HTML to markdown as a chain of replacements, for pages without deep nesting; sources/markup.py has the general reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapsed

#: In order. The patterns also hold in RE2, which has no look-around.
STEPS = (
    (r"(?is)<script[^>]*>.*?</script>", ""),
    (r"(?is)<style[^>]*>.*?</style>", ""),
    (r"(?is)<title[^>]*>.*?</title>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?i)<!doctype[^>]*>", ""),
    (r"(?i)<h1[^>]*>", "\n\n# "),
    (r"(?is)<a[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>", "[$2]($1)"),
    (r"(?i)<li[^>]*>", "\n- "),
    (r"(?i)<br[^>]*>", "  \n"),
    (r"(?i)</?(p|div|article|nav|ul|footer|h1)( [^>]*)?>", "\n\n"),
    (r"(?is)<b>(.*?)</b>", "**$1**"),
    (r"<[^>]*>", ""),
    (r"&copy;", "©"),
    (r"&middot;", "·"),
    (r"&quot;", "\""),
    (r"&amp;", "&"),
    (r"(?m)[ \t]+$", ""),
)


def html_to_markdown(html: Column) -> Column:
    for pattern, to in STEPS:
        html = F.regexp_replace(html, pattern, to)
    return F.trim(collapsed(html))


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
