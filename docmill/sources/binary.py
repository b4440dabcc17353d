"""Binary word-processor, spreadsheet and presentation files: compound files whose streams hold records."""

from __future__ import annotations

import datetime
import re
import struct

from docmill.errors import DocumentError

from .mail import compound_streams
from .markup import tidy
from .office import pipe_table


def _stream(data: bytes, *names: str) -> tuple[dict[str, bytes], bytes]:
    streams = compound_streams(data)
    for name in names:
        if name in streams:
            return streams, streams[name]
    raise DocumentError("failed", f"no stream {names[0]}")


def _narrow(raw: bytes) -> str:
    return raw.decode("cp1252", "replace")


# ---------------------------------------------------------------- properties

def properties(streams: dict[str, bytes]) -> dict:
    """Title, author and dates of the summary stream; nothing where it cannot be read."""
    raw = streams.get("\x05SummaryInformation", b"")
    out: dict = {}
    try:
        (at,) = struct.unpack_from("<I", raw, 44)
        _, n = struct.unpack_from("<II", raw, at)
        for i in range(min(n, 64)):
            key, offset = struct.unpack_from("<II", raw, at + 8 + 8 * i)
            (kind,) = struct.unpack_from("<I", raw, at + offset)
            value = None
            if kind == 30:
                (size,) = struct.unpack_from("<I", raw, at + offset + 4)
                value = _narrow(raw[at + offset + 8 : at + offset + 8 + size]).rstrip("\0")
            elif kind == 64:
                (ticks,) = struct.unpack_from("<Q", raw, at + offset + 4)
                if ticks:
                    value = (datetime.datetime(1601, 1, 1) + datetime.timedelta(microseconds=ticks // 10)).strftime("%Y-%m-%dT%H:%M:%SZ")
            name = {2: "title", 4: "author", 12: "created", 13: "modified"}.get(key)
            if name and value:
                out[name] = value
    except (struct.error, OverflowError):
        pass
    return out


# ---------------------------------------------------------------- word-processor files

def _pieces(body: bytes, table: bytes) -> str:
    """All characters, put together from the piece table."""
    at, size = struct.unpack_from("<II", body, 0x1A2)
    clx, k = table[at : at + size], 0
    while k < len(clx) and clx[k] == 1:
        k += 3 + struct.unpack_from("<H", clx, k + 1)[0]
    if k >= len(clx) or clx[k] != 2:
        raise DocumentError("failed", "no piece table")
    (size,) = struct.unpack_from("<I", clx, k + 1)
    n = (size - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", clx, k + 5)
    out = []
    for i in range(n):
        (where,) = struct.unpack_from("<I", clx, k + 5 + 4 * (n + 1) + 8 * i + 2)
        count = ends[i + 1] - ends[i]
        if where & 0x40000000:
            start = (where & 0x3FFFFFFF) // 2
            out.append(_narrow(body[start : start + count]))
        else:
            out.append(body[where : where + 2 * count].decode("utf-16-le", "replace"))
    return "".join(out)


def word(data: bytes) -> dict:
    """Paragraphs of the main text; rows of tables become pipe tables; field codes are left out, their results stay."""
    streams, body = _stream(data, "WordDocument")
    if len(body) < 0x1AA or body[:2] != b"\xec\xa5":
        raise DocumentError("failed", "not a word-processor file of a known version")
    flags, (main,) = struct.unpack_from("<H", body, 10)[0], struct.unpack_from("<I", body, 0x4C)
    if flags & 0x100:
        raise DocumentError("failed", "the file is encrypted")
    text = _pieces(body, streams.get("1Table" if flags & 0x200 else "0Table", b""))[:main]
    text = re.sub("\x13[^\x13\x14\x15]*\x14([^\x13\x15]*)\x15", r"\1", text)
    text = re.sub("\x13[^\x15]*\x15", "", text).replace("\x1e", "-").replace("\x1f", "").replace("\xa0", " ")
    out, rows, row = [], [], []
    for part in re.findall("[^\r\x07\x0c]*[\r\x07\x0c]|[^\r\x07\x0c]+$", text):
        end = part[-1] if part[-1] in "\r\x07\x0c" else ""
        words = re.sub(r"[\x00-\x08\x0e-\x1f]", "", part.rstrip("\r\x07\x0c").replace("\x0b", "\n")).strip()
        if end == "\x07":
            if words or not row:
                row.append(words.replace("\n", " "))
                closing = False
            else:
                closing = True
            if closing:  # an empty mark after cells ends a row
                rows.append(row)
                row = []
            continue
        if rows and not row:
            out.append(pipe_table(rows))
            rows = []
        if words:
            out.append(words)
    if row:
        rows.append(row)
    if rows:
        out.append(pipe_table(rows))
    return {"markdown": tidy("\n\n".join(out)).strip(), "metadata": properties(streams), "stats": {}}


# ---------------------------------------------------------------- spreadsheets

def _records(raw: bytes):
    at = 0
    while at + 4 <= len(raw):
        kind, size = struct.unpack_from("<HH", raw, at)
        yield at, kind, raw[at + 4 : at + 4 + size]
        at += 4 + size


class _Strings:
    """Reads strings that may go on in further records, each beginning with a new flag byte in the middle of characters."""

    def __init__(self, parts: list[bytes]) -> None:
        self.parts, self.k, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n and self.k < len(self.parts):
            got = self.parts[self.k][self.at : self.at + n]
            out, n, self.at = out + got, n - len(got), self.at + len(got)
            if n:
                self.k, self.at = self.k + 1, 0
        return out

    def text(self) -> str:
        count, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = "", flags & 1
        while count:
            if self.at == len(self.parts[self.k]):
                self.k, self.at = self.k + 1, 0
                if self.k == len(self.parts):
                    break
                wide = self.take(1)[0] & 1
            some = min(count, (len(self.parts[self.k]) - self.at) // (2 if wide else 1)) or 1
            raw = self.take(some * (2 if wide else 1))
            out += raw.decode("utf-16-le", "replace") if wide else raw.decode("latin-1")
            count -= some
        self.take(4 * runs + extra)
        return out


def _plain_text(raw: bytes, long: bool) -> str:
    n, flags = struct.unpack_from("<HB" if long else "<BB", raw)
    start = 3 if long else 2
    return raw[start : start + 2 * n].decode("utf-16-le", "replace") if flags & 1 else raw[start : start + n].decode("latin-1")


def _rk(value: int) -> float:
    x = float(value >> 2 if value < 1 << 31 else (value >> 2) - (1 << 30)) if value & 2 else struct.unpack("<d", struct.pack("<Q", (value & 0xFFFFFFFC) << 32))[0]
    return x / 100 if value & 1 else x


#: Numbers of built-in formats that show dates.
_DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def sheets(raw: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows) of each worksheet of a workbook stream, cells as they would be written."""
    names, strings, formats, styles, parts = [], [], {}, [], []
    base = datetime.datetime(1899, 12, 30)
    for _, kind, r in _records(raw):
        if parts and kind != 0x3C:
            reader = _Strings(parts)
            n = struct.unpack("<II", reader.take(8))[1]
            try:
                strings = [reader.text() for _ in range(n)]
            except (struct.error, IndexError):
                raise DocumentError("failed", "the table of strings is cut off") from None
            parts = []
        if kind == 0x2F:
            raise DocumentError("failed", "the file is encrypted")
        if kind == 0x85:
            where, _, sort = struct.unpack_from("<IBB", r)
            if sort == 0:
                names.append((where, _plain_text(r[6:], False)))
        elif kind == 0xFC or kind == 0x3C and parts:
            parts.append(r)
        elif kind == 0x41E:
            formats[struct.unpack_from("<H", r)[0]] = _plain_text(r[2:], True)
        elif kind == 0xE0:
            styles.append(struct.unpack_from("<H", r, 2)[0])
        elif kind == 0x22 and r[:1] == b"\x01":
            base = datetime.datetime(1904, 1, 1)
        elif kind == 0x0A:
            break

    def shown(x: float, style: int) -> str:
        code = styles[style] if style < len(styles) else 0
        own = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", formats.get(code, "")).lower()
        if (code in _DATES or re.search(r"[ymdhs]", own) and "general" not in own) and 0 <= x < 2958466:
            return str(base + datetime.timedelta(seconds=round(x * 86400)))
        return str(int(x)) if x == int(x) and abs(x) < 1 << 53 else repr(x)

    out = []
    for where, name in names:
        cells: dict[tuple[int, int], str] = {}
        waiting, depth = None, 0
        for _, kind, r in _records(raw[where:]):
            if kind == 0x809:
                depth += 1
            elif kind == 0x0A:
                depth -= 1
                if depth == 0:
                    break
            if depth != 1 or len(r) < 6 and kind != 0x207:
                continue
            if kind == 0x207 and waiting:
                cells[waiting], waiting = _plain_text(r, True), None
                continue
            if kind not in (0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x06, 0x205):
                continue
            y, x, style = struct.unpack_from("<HHH", r)
            if kind == 0xFD:
                k = struct.unpack_from("<I", r, 6)[0]
                cells[y, x] = strings[k] if k < len(strings) else ""
            elif kind == 0x204:
                cells[y, x] = _plain_text(r[6:], True)
            elif kind == 0x203:
                cells[y, x] = shown(struct.unpack_from("<d", r, 6)[0], style)
            elif kind == 0x27E:
                cells[y, x] = shown(_rk(struct.unpack_from("<I", r, 6)[0]), style)
            elif kind == 0xBD:
                for k in range((len(r) - 6) // 6):
                    style, value = struct.unpack_from("<HI", r, 4 + 6 * k)
                    cells[y, x + k] = shown(_rk(value), style)
            elif kind == 0x205:
                cells[y, x] = ("True" if r[6] else "False") if not r[7] else "#ERR"
            elif r[12:14] != b"\xff\xff":
                cells[y, x] = shown(struct.unpack_from("<d", r, 6)[0], style)
            elif r[6] == 0:
                waiting = (y, x)
            elif r[6] == 1:
                cells[y, x] = "True" if r[8] else "False"
        height, width = (max((k[i] for k in cells), default=-1) + 1 for i in (0, 1))
        out.append((name, [[cells.get((y, x), "") for x in range(width)] for y in range(height)]))
    return out


def workbook(data: bytes, cap: int, structured: bool) -> dict:
    streams, raw = _stream(data, "Workbook")
    found = sheets(raw)
    meta = properties(streams) | {"sheet_count": len(found)}
    out = {"markdown": tidy("\n\n".join(f"## {name}\n\n{pipe_table(rows)}".strip() for name, rows in found)).strip(), "metadata": meta, "stats": {}}
    if structured:
        meta["sheet_names"] = [n for n, _ in found]
        out["sheets"] = [{"name": n, "rows": rows[:cap], "truncated": len(rows) > cap} for n, rows in found]
    return out


# ---------------------------------------------------------------- presentations

def _atoms(raw: bytes, at: int, end: int, depth: int = 0):
    """(type, instance, content) of records that are no containers, in order; containers are (type, None, None) before theirs."""
    while at + 8 <= end and depth < 64:
        head, kind, size = struct.unpack_from("<HHI", raw, at)
        to = min(end, at + 8 + size)
        if head & 15 == 15:
            yield kind, None, head >> 4
            yield from _atoms(raw, at + 8, to, depth + 1)
        else:
            yield kind, head >> 4, raw[at + 8 : to]
        at = to


def presentation(data: bytes, structured: bool) -> dict:
    """Texts of slides and of notes, from the lists of slide texts and the text boxes of the slides themselves."""
    streams, raw = _stream(data, "PowerPoint Document")
    text_of = {0x0FA0: lambda r: r.decode("utf-16-le", "replace"), 0x0FA8: lambda r: r.decode("latin-1")}
    listed: list[list[tuple[str, str]]] = []
    drawn: list[list[tuple[str, str]]] = []
    notes: list[list[str]] = []
    into, kind_of_text = None, 4
    for kind, instance, r in _atoms(raw, 0, len(raw)):
        if instance is None:
            if kind in (0x03EE, 0x03F0, 0x03F8, 0x0FF0):  # slide, notes, master, list of slides' texts
                into = {0x03EE: "slide", 0x03F0: "notes", 0x0FF0: "list" if r == 0 else None}.get(kind)
                if into == "slide":
                    drawn.append([])
                elif into == "notes":
                    notes.append([])
        elif kind == 0x03F3 and into == "list":
            listed.append([])
        elif kind == 0x0F9F and len(r) >= 4:
            kind_of_text = struct.unpack_from("<I", r)[0]
        elif kind in text_of and into:
            text = text_of[kind](r).replace("\r", "\n").replace("\x0b", "\n").strip()
            if text and into == "notes" and not text.isdigit() and text != "*":
                notes[-1].append(text)
            elif text and into in ("slide", "list") and (drawn if into == "slide" else listed):
                (drawn if into == "slide" else listed)[-1].append(("title" if kind_of_text in (0, 6) else "text", text))
    n = max(len(listed), len(drawn))
    slides = [[*(listed[i] if i < len(listed) else []), *(drawn[i] if i < len(drawn) else [])] for i in range(n)]
    # Notes belong to slides by their order only where each slide has its own.
    said = ["\n".join(x) for x in notes] if len(notes) == n else [""] * n
    out = []
    for k, parts in enumerate(slides):
        body = "\n\n".join(f"# {t}" if kind == "title" else t for kind, t in parts)
        out.append(f"<!-- Slide number: {k + 1} -->\n{body}" + (f"\n\n### Notes:\n{said[k]}" if said[k] else ""))
    found = {"markdown": tidy("\n\n".join(out)).strip(), "metadata": properties(streams) | {"slide_count": n}, "stats": {}}
    if structured:
        found["slides"] = [{"slide": k + 1, "text": "\n".join(t for _, t in parts), "notes": said[k]} for k, parts in enumerate(slides)]
    return found
