"""E-mail messages, mailboxes and compound-file messages to fields."""

from __future__ import annotations

import email
import struct
from email import policy
from email.header import decode_header

from docmill.errors import DocumentError

from .markup import html_to_markdown

NO_SUBJECT, UNKNOWN, NO_BODY = "(no subject)", "(unknown)", "(no body)"


def text_of(data: bytes, charset: str | None) -> str:
    """By the declared charset, else UTF-8, Windows-1252, Latin-1."""
    for c in (charset, "utf-8", "cp1252", "latin-1"):
        if c:
            try:
                return data.decode(c)
            except (LookupError, UnicodeDecodeError):
                continue
    return data.decode("utf-8", "replace")


def header(value) -> str:
    """Encoded words decoded; the raw value where that fails."""
    raw = str(value) if value is not None else ""
    try:
        return "".join(text_of(p, c) if isinstance(p, bytes) else p for p, c in decode_header(raw)).strip()
    except Exception:
        return raw.strip()


def fields(data: bytes) -> dict:
    """schema.MAIL of one message."""
    msg = email.message_from_bytes(data, policy=policy.compat32)
    plain, html, attachments = None, None, []
    for part in msg.walk() if msg.is_multipart() else [msg]:
        if part.is_multipart():
            continue
        kind, name = part.get_content_type(), part.get_filename()
        how = (part.get("Content-Disposition") or "").lower()
        payload = part.get_payload(decode=True) or b""
        if msg.is_multipart() and name and ("attachment" in how or "inline" in how and not kind.startswith("text/")):
            attachments.append({"name": header(name), "size": len(payload)})
        elif kind == "text/html" and html is None:
            html = text_of(payload, part.get_content_charset())
        elif (kind == "text/plain" or not msg.is_multipart()) and not plain:
            plain = text_of(payload, part.get_content_charset())
    body = plain.strip() if plain else html_to_markdown(html)[0] if html else NO_BODY
    get = lambda name: header(msg.get(name))
    out = {"subject": get("Subject") or NO_SUBJECT, "from": get("From") or UNKNOWN, "to": get("To"), "cc": get("Cc"), "bcc": get("Bcc"), "reply_to": get("Reply-To")}
    raw = lambda name: str(msg.get(name) or "")
    return out | {"date": raw("Date"), "message_id": raw("Message-ID"), "in_reply_to": raw("In-Reply-To"), "references": raw("References"), "body": body or NO_BODY, "attachments": attachments}


def split_mailbox(data: bytes, most: int) -> list[bytes]:
    """Messages between lines that begin with `From `; one more than `most` is an error."""
    if not data or not (data.startswith(b"From ") or b"\nFrom " in data[:256]):
        raise DocumentError("invalid_mbox", "not a mailbox")
    out, current = [], None
    for line in data.splitlines(keepends=True):
        if line.startswith(b"From "):
            if current is not None:
                out.append(b"".join(current))
            current = []
        elif current is not None:
            current.append(line[1:] if line.startswith(b">From ") else line)
    if current is not None:
        out.append(b"".join(current))
    if len(out) > most:
        raise DocumentError("invalid_mbox", f"more than {most} messages; please split the file")
    return out


# ---------------------------------------------------------------- compound files

_FREE, _END = 0xFFFFFFFF, 0xFFFFFFFE


def compound_streams(data: bytes) -> dict[str, bytes]:
    """Streams by path of a compound file (sectors chained by allocation tables)."""
    if data[:8] != bytes.fromhex("D0CF11E0A1B11AE1"):
        raise DocumentError("unsupported", "not a compound file")
    shift, mini_shift = struct.unpack_from("<HH", data, 30)
    size = 1 << shift
    _, directory, _, cutoff, mini_fat, _, difat, _ = struct.unpack_from("<8I", data, 44)
    sector = lambda i: data[(i + 1) << shift : (i + 2) << shift]
    fats = [x for x in struct.unpack_from("<109I", data, 76) if x < _END]
    seen = 0
    while difat < _END and seen < 1 << 16:
        part = struct.unpack(f"<{size // 4}I", sector(difat).ljust(size, b"\xff"))
        fats += [x for x in part[:-1] if x < _END]
        difat, seen = part[-1], seen + 1
    fat = [x for f in fats for x in struct.unpack(f"<{size // 4}I", sector(f).ljust(size, b"\xff"))]

    def chain(first: int, table: list[int]) -> list[int]:
        out = []
        while first < _END and first < len(table) and len(out) <= len(table):
            out.append(first)
            first = table[first]
        return out

    read = lambda first: b"".join(sector(i) for i in chain(first, fat))
    entries = []
    raw = read(directory)
    for i in range(0, len(raw) - 127, 128):
        length, kind = struct.unpack_from("<HB", raw, i + 64)
        left, right, child = struct.unpack_from("<III", raw, i + 68)
        first, total = struct.unpack_from("<II", raw, i + 116)
        entries.append((raw[i : i + max(0, length - 2)].decode("utf-16-le", "replace"), kind, left, right, child, first, total))
    if not entries:
        return {}
    mini = read(entries[0][5])
    small = read(mini_fat)
    mini_table = list(struct.unpack(f"<{len(small) // 4}I", small[: len(small) // 4 * 4]))
    out: dict[str, bytes] = {}

    def walk(i: int, path: str, depth: int = 0) -> None:
        if i >= len(entries) or depth > 10_000:
            return
        name, kind, left, right, child, first, total = entries[i]
        walk(left, path, depth + 1)
        if kind == 2:
            whole = b"".join(mini[s << mini_shift : (s + 1) << mini_shift] for s in chain(first, mini_table)) if total < cutoff else read(first)
            out[path + name] = whole[:total]
        elif kind == 1:
            walk(child, f"{path}{name}/", depth + 1)
        walk(right, path, depth + 1)

    walk(entries[0][4], "")
    return out


def msg_fields(data: bytes) -> dict:
    """schema.MAIL of a compound-file message, from its property streams."""
    streams = compound_streams(data)

    def prop(tag: str, at: str = "") -> str:
        wide, narrow = streams.get(f"{at}__substg1.0_{tag}001F"), streams.get(f"{at}__substg1.0_{tag}001E")
        return wide.decode("utf-16-le", "replace").rstrip("\0") if wide is not None else text_of(narrow, None).rstrip("\0") if narrow is not None else ""

    html = streams.get("__substg1.0_10130102")
    body = prop("1000").strip() or (html_to_markdown(text_of(html, None))[0] if html else "") or NO_BODY
    files = sorted({p.split("/")[0] + "/" for p in streams if p.startswith("__attach")})
    attachments = [{"name": n, "size": len(streams.get(f"{a}__substg1.0_37010102", b""))} for a in files if (n := prop("3707", a) or prop("3704", a))]
    sender = " ".join(x for x in (prop("0C1A"), f"<{prop('0C1F')}>" if prop("0C1F") else "") if x)
    return {"subject": prop("0037") or NO_SUBJECT, "from": sender or UNKNOWN, "to": prop("0E04"), "cc": prop("0E03"), "bcc": prop("0E02"), "reply_to": "", "date": "", "message_id": prop("1035"), "in_reply_to": prop("1042"), "references": prop("1039"), "body": body, "attachments": attachments}
