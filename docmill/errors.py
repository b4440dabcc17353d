"""Kinds of failure and their status codes. Failures are rows with a status, not exceptions of a job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error kind -> status.
STATUS = {
    "unsupported": 415,
    "encrypted_pdf": 415,
    "invalid_mbox": 415,
    "needs_ocr": 422,
    "malicious_file": 422,
    "decompression_bomb": 413,
    "too_large": 413,
    "bad_request": 400,
    "timeout": 504,
    "converter_unavailable": 500,
}
DEFAULT_STATUS = 500


class DocumentError(Exception):
    """Raised by kernels; turned into a row with `kind` and the status of that kind."""

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(message)
        self.kind = kind


def kind_of(error: BaseException) -> str | None:
    if isinstance(error, DocumentError):
        return error.kind
    return "timeout" if isinstance(error, TimeoutError) else None


def status(kind: Column) -> Column:
    """200 without an error kind; kinds that are not listed are 500."""
    out = F.when(kind.isNull(), F.lit(200))
    for name, code in STATUS.items():
        out = out.when(kind == name, F.lit(code))
    return out.otherwise(F.lit(DEFAULT_STATUS))


def message(text: Column, most: int = 500) -> Column:
    return F.substring(text, 1, most)
