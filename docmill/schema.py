"""Schemas of what the engine returns."""

from __future__ import annotations

from pyspark.sql import types as T

_STRINGS = ("title", "author", "created", "modified")
_COUNTS = ("page_count", "slide_count", "sheet_count", "message_count", "row_count", "column_count", "width", "height")


def _of(**kinds) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


METADATA = T.StructType(
    [T.StructField(x, T.StringType()) for x in _STRINGS]
    + [T.StructField(x, T.IntegerType()) for x in _COUNTS]
    + [T.StructField("sheet_names", T.ArrayType(T.StringType()))]
    + [T.StructField(x, T.StringType()) for x in ("image_format", "message_id", "document_type", "scene_type", "language", "source")]
)
PAGES = T.ArrayType(_of(page=T.IntegerType(), markdown=T.StringType()))
SHEETS = T.ArrayType(_of(name=T.StringType(), rows=T.ArrayType(T.ArrayType(T.StringType())), truncated=T.BooleanType()))
SLIDES = T.ArrayType(_of(slide=T.IntegerType(), text=T.StringType(), notes=T.StringType()))
ATTACHMENTS = T.ArrayType(_of(name=T.StringType(), size=T.LongType()))
MAIL_FIELDS = ("subject", "from", "to", "cc", "bcc", "reply_to", "date", "message_id", "in_reply_to", "references", "body")
MAIL = T.StructType([T.StructField(x, T.StringType()) for x in MAIL_FIELDS] + [T.StructField("attachments", ATTACHMENTS)])
STRUCTURED = _of(
    pages=PAGES, sheets=SHEETS, slides=SLIDES, columns=T.ArrayType(T.StringType()), rows=T.ArrayType(T.ArrayType(T.StringType())), truncated=T.BooleanType(),
    mail=MAIL, messages=T.ArrayType(_of(index=T.IntegerType(), mail=MAIL)), truncated_after=T.IntegerType(), json=T.StringType(), raw=T.StringType(), text=T.StringType(),
)
STATS = T.MapType(T.StringType(), T.LongType())
#: What a kernel gives for one file.
PARSED = _of(parser=T.StringType(), markdown=T.StringType(), structured=STRUCTURED, metadata=METADATA, stats=STATS, error_kind=T.StringType(), error=T.StringType())
#: width: of the page.
WORDS = _of(doc_id=T.StringType(), page=T.IntegerType(), seq=T.IntegerType(), text=T.StringType(), x0=T.DoubleType(), x1=T.DoubleType(), top=T.DoubleType(), size=T.DoubleType(), width=T.DoubleType())
