"""One function per parser: bytes to a dictionary of the fields of schema.PARSED. Failures are DocumentErrors."""

from __future__ import annotations

from docmill import registry
from docmill.conf import Settings
from docmill.errors import DocumentError, kind_of

from . import binary, mail, markup, office, pdf, plain


def _pdf(data, ext, settings, structured):
    found = pdf.pdf_words(data)
    return {"parser": "pdf", "words": found["words"], "metadata": {"page_count": found["pages"], "title": found["info"].get("Title"), "author": found["info"].get("Author")}, "pdf": {"created": found["info"].get("CreationDate", ""), "modified": found["info"].get("ModDate", ""), "creator": f"{found['info'].get('Creator', '')} {found['info'].get('Producer', '')}", "width": found["width"]}}


def _is_compound(data) -> bool:
    """Whether a file is of the binary formats; one that is neither of these nor an archive cannot be converted."""
    if data[:4] not in (b"\xd0\xcf\x11\xe0", b"PK\x03\x04"):
        raise DocumentError("failed", "neither an archive nor a binary office file")
    return data[:1] == b"\xd0"


def _docx(data, ext, settings, structured):
    found = office.odt(data) if ext == ".odt" else binary.word(data) if _is_compound(data) else office.docx(data)
    return {"parser": "docx", **found}


def _pptx(data, ext, settings, structured):
    found = (binary if _is_compound(data) else office).presentation(data, structured)
    return {"parser": "pptx", **found, "structured": {"slides": found.get("slides")}}


def _xlsx(data, ext, settings, structured):
    found = (binary if _is_compound(data) else office).workbook(data, settings.max_rows_per_sheet, structured)
    return {"parser": "xlsx", **found, "structured": {"sheets": found.get("sheets")}}


def _csv(data, ext, settings, structured):
    found = plain.delimited(data, "\t" if ext == ".tsv" else ",", settings.max_rows_per_sheet)
    meta = {"row_count": len(found["rows"]), "column_count": len(found["columns"])} if structured else {}
    return {"parser": "csv", "markdown": found.pop("markdown"), "structured": found, "metadata": meta}


def _mail_meta(f):
    return {"title": f["subject"], "author": f["from"], "created": f["date"], "message_id": f["message_id"]}


def _email(data, ext, settings, structured):
    f = mail.fields(data)
    return {"parser": "email", "structured": {"mail": f}, "metadata": _mail_meta(f)}


def _msg(data, ext, settings, structured):
    f = mail.msg_fields(data)
    return {"parser": "msg", "structured": {"mail": f}, "metadata": _mail_meta(f)}


def _mbox(data, ext, settings, structured):
    out = []
    for i, raw in enumerate(mail.split_mailbox(data, settings.mbox_max_messages), 1):
        try:
            out.append({"index": i, "mail": mail.fields(raw)})
        except Exception as e:  # one message that cannot be read leaves the others
            out.append({"index": i, "mail": None, "error": f"{type(e).__name__}: {e}"})
    return {"parser": "mbox", "messages": out}


def _image(data, ext, settings, structured):
    kind, width, height = plain.image_info(data)
    return {"parser": "image", "markdown": None, "metadata": {"width": width, "height": height, "image_format": kind}, "structured": {"text": ""}, "engine": settings.ocr_engine()}


def _html(data, ext, settings, structured):
    text, title = markup.html_to_markdown(plain.decoded(data))
    return {"parser": "html", "markdown": text, "metadata": {"title": title}}


def _rtf(data, ext, settings, structured):
    return {"parser": "rtf", "markdown": plain.rtf_text(data)}


def _json(data, ext, settings, structured):
    text, found, raw = plain.json_document(data)
    return {"parser": "json", "markdown": text, "structured": {"json": found, "raw": raw}}


KERNELS = {"pdf": _pdf, "docx": _docx, "pptx": _pptx, "xlsx": _xlsx, "csv": _csv, "email": _email, "msg": _msg, "mbox": _mbox, "image": _image, "html": _html, "rtf": _rtf, "json": _json}


def parse(parser: str, ext: str, data: bytes, settings: Settings, structured: bool, extra: dict | None = None) -> dict:
    """A row as a dictionary; never raises. `extra` are kernels that were registered."""
    kernel = (extra or {}).get(parser) or registry.KERNELS.get(parser) or KERNELS.get(parser)
    try:
        if kernel is None:
            raise DocumentError("unsupported", f"no reader for {ext}")
        found = kernel(data, ext, settings, structured)
        return {"error_kind": None, "error": None, **found}
    except DocumentError as e:
        return {"error_kind": e.kind, "error": str(e)[:1000]}
    except Exception as e:
        return {"error_kind": kind_of(e) or "failed", "error": f"{type(e).__name__}: {e}"[:1000]}
