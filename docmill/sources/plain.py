"""Delimited text, JSON, RTF and image headers."""

from __future__ import annotations

import csv
import io
import json
import re
import struct

from docmill.errors import DocumentError

from .markup import pipe_table, tidy


def decoded(data: bytes) -> str:
    """UTF-8 without its mark, else Latin-1."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def delimited(data: bytes, sep: str, cap: int) -> dict:
    """Head and rows of a delimited file, all cells text and all columns kept; at most `cap` rows, with a flag for more."""
    csv.field_size_limit(1 << 30)
    rows = [r for r in csv.reader(io.StringIO(decoded(data), newline=""), delimiter=sep) if r]
    columns, body = (rows[0], rows[1:]) if rows else ([], [])
    kept = body[:cap]
    return {"columns": columns, "rows": kept, "truncated": len(body) > cap, "markdown": pipe_table([columns, *kept]) if columns else ""}


def json_document(data: bytes) -> tuple[str, str | None, str | None]:
    """(markdown, JSON text, raw text): pretty with keys in their order, or the raw text where it is no JSON."""
    text = decoded(data)
    try:
        shown = json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    except (ValueError, RecursionError):
        return f"```\n{text}\n```", None, text
    return f"```json\n{shown}\n```", shown, None


# ---------------------------------------------------------------- RTF

_TOKEN = re.compile(r"\\([a-zA-Z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
#: Groups whose text is not part of the document, and control words that stand for characters.
_SILENT = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "headerl", "headerr", "footerl", "footerr", "themedata", "colorschememapping", "datastore", "listtable", "listoverridetable", "rsidtbl", "generator", "latentstyles", "object"}
_CHARACTERS = {"par": "\n\n", "line": "\n", "tab": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "cell": " | ", "row": "\n", "page": "\n\n", "sect": "\n\n"}


def rtf_text(data: bytes) -> str:
    text = data.decode("latin-1")
    if not text.lstrip().startswith("{\\rtf"):
        raise DocumentError("unsupported", "not an RTF file")
    out, stack = [], []
    silent, skip_after, skip, charset = False, 1, 0, "cp1252"
    for m in _TOKEN.finditer(text):
        word, number, code, symbol, brace, plain = m.groups()
        if brace == "{":
            stack.append((silent, skip_after))
        elif brace == "}":
            silent, skip_after = stack.pop() if stack else (False, 1)
        elif symbol == "*":
            silent = True
        elif word:
            if word in _SILENT:
                silent = True
            elif word == "ansicpg" and number:
                charset = f"cp{number}"
            elif word == "uc" and number:
                skip_after = int(number)
            elif silent:
                continue
            elif word == "u" and number:
                out.append(chr(int(number) % 0x10000))
                skip = skip_after
            elif word in _CHARACTERS:
                out.append(_CHARACTERS[word])
        elif silent:
            continue
        elif code:
            if skip:
                skip -= 1
            else:
                try:
                    out.append(bytes([int(code, 16)]).decode(charset))
                except (LookupError, UnicodeDecodeError):
                    out.append(bytes([int(code, 16)]).decode("latin-1"))
        elif symbol:
            out.append({"~": "\u00a0", "_": "-", "-": "", "\n": "\n\n", "\r": "\n\n"}.get(symbol, symbol))
        elif plain:
            used = min(skip, len(plain))
            skip -= used
            out.append(plain[used:])
    joined = "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return tidy(joined).strip()


# ---------------------------------------------------------------- image headers

def image_info(data: bytes) -> tuple[str, int, int]:
    """(format, width, height) from the first bytes."""
    try:
        if data.startswith(b"\x89PNG\r\n\x1a\n"):
            return ("PNG", *struct.unpack_from(">II", data, 16))
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return ("GIF", *struct.unpack_from("<HH", data, 6))
        if data.startswith(b"BM"):
            w, h = struct.unpack_from("<ii", data, 18)
            return "BMP", w, abs(h)
        if data.startswith(b"RIFF") and data[8:12] == b"WEBP":
            return ("WEBP", *_webp(data))
        if data[:4] in (b"II*\0", b"MM\0*"):
            return ("TIFF", *_tiff(data))
        if data.startswith(b"\xff\xd8"):
            return ("JPEG", *_jpeg(data))
    except (struct.error, IndexError, KeyError) as e:
        raise DocumentError("unsupported", "damaged image header") from e
    raise DocumentError("unsupported", "not a known image format")


def _webp(data: bytes) -> tuple[int, int]:
    kind = data[12:16]
    if kind == b"VP8X":
        return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
    if kind == b"VP8L":
        bits = struct.unpack_from("<I", data, 21)[0]
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    w, h = struct.unpack_from("<HH", data, 26)
    return w & 0x3FFF, h & 0x3FFF


def _tiff(data: bytes) -> tuple[int, int]:
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(f"{order}I", data, 4)[0]
    found = {}
    for i in range(struct.unpack_from(f"{order}H", data, at)[0]):
        tag, kind, _, wide = struct.unpack_from(f"{order}HHII", data, at + 2 + 12 * i)
        found[tag] = struct.unpack_from(f"{order}H", data, at + 10 + 12 * i)[0] if kind == 3 else wide
    return found[256], found[257]


def _jpeg(data: bytes) -> tuple[int, int]:
    at = 2
    while True:
        while data[at] != 0xFF:
            at += 1
        kind = data[at + 1]
        if kind == 0xFF or kind == 1 or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", data, at + 5)
            return w, h
        at += 2 + struct.unpack_from(">H", data, at + 2)[0]
