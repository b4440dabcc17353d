"""Office archives: zip directories, hardened XML, word-processor, spreadsheet and presentation files of both families."""

from __future__ import annotations

import html
import io
import re
import zipfile
from xml.parsers import expat

from docmill.errors import DocumentError

from .markup import pipe_table, tidy


def entries(data: bytes) -> list[tuple[str, int, int]]:
    """(name, file_size, compress_size) of an archive; nothing for what is none or is damaged."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return [(i.filename, i.file_size, i.compress_size) for i in z.infolist()]
    except Exception:
        return []


class Node:
    __slots__ = ("name", "attrs", "children", "text")

    def __init__(self, name: str, attrs: dict) -> None:
        self.name, self.attrs, self.children, self.text = name, attrs, [], ""

    def all(self, *names: str):
        for c in self.children:
            if c.name in names:
                yield c
            yield from c.all(*names)

    def child(self, name: str):
        return next((c for c in self.children if c.name == name), None)

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name, default)

    def deep_text(self) -> str:
        return self.text if self.name == "#text" else "".join(c.deep_text() for c in self.children)


def parsed(data: bytes) -> Node:
    """The tree, names without namespaces. Document types, and so all entities of their own, are refused."""
    root = Node("#root", {})
    stack = [root]
    parser = expat.ParserCreate(namespace_separator=" ")
    local = lambda n: n.rsplit(" ", 1)[-1]

    def start(name, attrs):
        node = Node(local(name), {local(k): v for k, v in attrs.items()})
        stack[-1].children.append(node)
        stack.append(node)

    def text(data):
        node = Node("#text", {})
        node.text = data
        stack[-1].children.append(node)

    def refuse(*_):
        raise DocumentError("unsupported", "XML with a document type is refused")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, lambda _: stack.pop(), text
    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = refuse
    parser.buffer_text = True
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        raise DocumentError("unsupported", f"damaged XML: {e}") from e
    return root.children[0] if root.children else root


class Archive:
    def __init__(self, data: bytes) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise DocumentError("unsupported", "not an office archive") from e
        self.names = self.zip.namelist()

    def xml(self, name: str) -> Node | None:
        return parsed(self.zip.read(name)) if name in self.names else None

    def numbered(self, pattern: str) -> list[str]:
        found = [(int(m[1]), n) for n in self.names if (m := re.fullmatch(pattern, n))]
        return [n for _, n in sorted(found)]

    def relations(self, part: str) -> dict[str, str]:
        folder, name = part.rsplit("/", 1) if "/" in part else ("", part)
        rels = self.xml(f"{folder}/_rels/{name}.rels".lstrip("/"))
        return {r.get("Id"): r.get("Target") for r in rels.all("Relationship")} if rels else {}


def core_properties(archive: Archive) -> dict:
    core, out = archive.xml("docProps/core.xml"), {}
    for key, name in (("title", "title"), ("author", "creator"), ("created", "created"), ("modified", "modified")):
        node = next(core.all(name), None) if core else None
        if node is not None and node.deep_text().strip():
            out[key] = node.deep_text().strip()
    if not out and (meta := archive.xml("meta.xml")):
        for key, names in (("title", ("title",)), ("author", ("initial-creator", "creator")), ("created", ("creation-date",)), ("modified", ("date",))):
            node = next(meta.all(*names), None)
            if node is not None and node.deep_text().strip():
                out[key] = node.deep_text().strip()
    return out


def media(archive: Archive, folder: str) -> list[tuple[str, bytes]]:
    names = [n for n in archive.names if n.startswith(folder) and n.lower().endswith((".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tif", ".tiff", ".webp"))]
    return [(n.rsplit("/", 1)[-1], archive.zip.read(n)) for n in sorted(names)]


# ---------------------------------------------------------------- equations

#: N-ary operators and accents.
_NARY = {"∑": "\\sum", "∏": "\\prod", "∫": "\\int", "∬": "\\iint", "⋃": "\\bigcup", "⋂": "\\bigcap"}
_ACCENTS = {"̂": "\\hat", "̃": "\\tilde", "̅": "\\bar", "⃗": "\\vec", "̇": "\\dot"}


def latex(node: Node | None) -> str:
    """Office math as LaTeX: fractions, scripts, radicals, n-ary operators, delimiters, functions, matrices, accents."""
    if node is None:
        return ""
    part = lambda name: latex(node.child(name))
    prop = lambda tag, default: next((c.get("val", default) for c in (node.child(f"{node.name}Pr") or Node("", {})).children if c.name == tag), default)
    kind = node.name
    if kind == "t":
        return node.deep_text()
    if kind.endswith("Pr") or kind == "#text":
        return ""
    if kind == "f":
        return f"\\frac{{{part('num')}}}{{{part('den')}}}"
    if kind == "sSup":
        return f"{{{part('e')}}}^{{{part('sup')}}}"
    if kind == "sSub":
        return f"{{{part('e')}}}_{{{part('sub')}}}"
    if kind == "sSubSup":
        return f"{{{part('e')}}}_{{{part('sub')}}}^{{{part('sup')}}}"
    if kind == "rad":
        degree = part("deg")
        return f"\\sqrt[{degree}]{{{part('e')}}}" if degree else f"\\sqrt{{{part('e')}}}"
    if kind == "nary":
        low, high = part("sub"), part("sup")
        sign = prop("chr", "∫")
        return _NARY.get(sign, sign) + (f"_{{{low}}}" if low else "") + (f"^{{{high}}}" if high else "") + f"{{{part('e')}}}"
    if kind == "d":
        inner = prop("sepChr", "|").join(latex(e) for e in node.children if e.name == "e")
        brace = lambda c: "\\" + c if c in "{}" and c else c or "."
        return f"\\left{brace(prop('begChr', '('))}{inner}\\right{brace(prop('endChr', ')'))}"
    if kind == "func":
        name = part("fName")
        return f"\\{name}{{{part('e')}}}" if name.isalpha() else f"{name}{{{part('e')}}}"
    if kind == "m":
        rows = " \\\\ ".join(" & ".join(latex(e) for e in r.children if e.name == "e") for r in node.children if r.name == "mr")
        return f"\\begin{{matrix}}{rows}\\end{{matrix}}"
    if kind == "acc":
        return f"{_ACCENTS.get(prop('chr', '̂'), chr(92) + 'hat')}{{{part('e')}}}"
    if kind == "bar":
        return f"\\overline{{{part('e')}}}"
    if kind in ("limLow", "limUpp"):
        return f"{{{part('e')}}}{'_' if kind == 'limLow' else '^'}{{{part('lim')}}}"
    return "".join(latex(c) for c in node.children)


# ---------------------------------------------------------------- word processing

#: Elements of tracked changes and what they are called.
CHANGES = {"ins": "insertion", "moveTo": "insertion", "del": "deletion", "moveFrom": "deletion"}


class _Docx:
    def __init__(self, archive: Archive) -> None:
        self.archive = archive
        self.links = archive.relations("word/document.xml")
        self.stats = {f"{s}_{k}": 0 for k in ("inline", "block") for s in ("source", "found", "missing")}
        styles = archive.xml("word/styles.xml")
        self.headings = {}
        for s in styles.all("style") if styles else ():
            name = s.child("name")
            m = re.fullmatch(r"(?i)heading (\d)", name.get("val")) if name is not None else None
            if m or name is not None and name.get("val").lower() == "title":
                self.headings[s.get("styleId")] = int(m[1]) if m else 1
        numbering, self.ordered = archive.xml("word/numbering.xml"), set()
        if numbering is not None:
            kinds = {a.get("abstractNumId"): [(lv.get("ilvl"), (lv.child("numFmt") or Node("", {})).get("val")) for lv in a.all("lvl")] for a in numbering.all("abstractNum")}
            for n in numbering.children:
                ref = n.child("abstractNumId") if n.name == "num" else None
                if ref is not None:
                    self.ordered |= {(n.get("numId"), level) for level, kind in kinds.get(ref.get("val"), ()) if kind not in ("bullet", "none", "")}
        self.counters: dict[tuple[str, str], int] = {}
        self.notes: list[str] = []

    def formula(self, node: Node, block: bool) -> str:
        kind = "block" if block else "inline"
        self.stats[f"source_{kind}"] += 1
        text = latex(node).strip()
        if not text:
            self.stats[f"missing_{kind}"] += 1
            return ""
        self.stats[f"found_{kind}"] += 1
        return f"\n\n```math\n{text}\n```\n\n" if block else f"$`{text}`$"

    def run(self, node: Node) -> str:
        out = []
        for c in node.children:
            if c.name in ("t", "delText"):
                out.append(c.deep_text())
            elif c.name == "tab":
                out.append("\t")
            elif c.name in ("br", "cr"):
                out.append("  \n")
            elif c.name == "footnoteReference":
                self.notes.append(c.get("id"))
                out.append(f"[^{c.get('id')}]")
        text, style = "".join(out), node.child("rPr")
        on = lambda tag: style is not None and (t := style.child(tag)) is not None and t.get("val", "1") not in ("0", "false")
        for tag, mark in (("i", "*"), ("b", "**"), ("strike", "~~")):
            body = text.strip()
            if body and on(tag):
                text = text.replace(body, f"{mark}{body}{mark}", 1)
        return text

    def inline(self, node: Node) -> str:
        out = []
        for c in node.children:
            if c.name == "r":
                out.append(self.run(c))
            elif c.name == "hyperlink":
                target = self.links.get(c.get("id"), "")
                out.append(f"[{self.inline(c)}]({target})" if target else self.inline(c))
            elif c.name == "oMathPara":
                out += [self.formula(m, True) for m in c.children if m.name == "oMath"]
            elif c.name == "oMath":
                out.append(self.formula(c, False))
            elif c.name in CHANGES:
                text = self.inline(c)
                marks = "".join(f' {k}="{html.escape(c.get(k))}"' for k in ("author", "date") if c.get(k))
                out.append(f'<span class="{CHANGES[c.name]}"{marks}>{text}</span>' if text else "")
            elif c.name not in ("pPr", "#text", "p", "tbl"):
                out.append(self.inline(c))  # fields, content controls
        return "".join(out).replace("****", "")

    def paragraph(self, node: Node) -> str:
        text, style = self.inline(node).strip("\n"), node.child("pPr")
        if not text.strip() or style is None:
            return text.strip()
        name, number = style.child("pStyle"), style.child("numPr")
        level = self.headings.get(name.get("val")) if name is not None else None
        if level:
            return "#" * min(level, 6) + " " + text.strip().replace("**", "")
        if number is not None:
            depth, of = (number.child(x).get("val", "0") if number.child(x) is not None else "0" for x in ("ilvl", "numId"))
            if of != "0":
                mark = "- "
                if (of, depth) in self.ordered:
                    self.counters[of, depth] = self.counters.get((of, depth), 0) + 1
                    mark = f"{self.counters[of, depth]}. "
                return "  " * int(depth or 0) + mark + text.strip()
        return text.strip()

    def blocks(self, node: Node) -> list[str]:
        out: list[str] = []
        for c in node.children:
            if c.name == "p":
                text = self.paragraph(c)
                if text:
                    item = re.match(r" *(-|\d+\.) ", text)
                    if item and out and re.match(r" *(-|\d+\.) ", out[-1].rsplit("\n", 1)[-1]):
                        out[-1] += "\n" + text
                    else:
                        out.append(text)
            elif c.name == "tbl":
                rows = [[" ".join(self.blocks(cell)) for cell in r.children if cell.name == "tc"] for r in c.children if r.name == "tr"]
                out.append(pipe_table(rows))
            elif c.name in ("sdt", "sdtContent", "body", "ins", "del"):
                out += self.blocks(c)
        return out

    def markdown(self) -> str:
        root = self.archive.xml("word/document.xml")
        if root is None:
            raise DocumentError("unsupported", "no document part")
        out = self.blocks(root)
        notes = self.archive.xml("word/footnotes.xml") if self.notes else None
        if notes is not None:
            by_id = {n.get("id"): " ".join(self.blocks(n)) for n in notes.all("footnote")}
            out += [f"[^{i}]: {by_id[i]}" for i in self.notes if i in by_id]
        return tidy("\n\n".join(out)).strip()


def docx(data: bytes) -> dict:
    archive = Archive(data)
    d = _Docx(archive)
    return {"markdown": d.markdown(), "metadata": core_properties(archive), "stats": d.stats, "images": media(archive, "word/media/")}


def odt(data: bytes) -> dict:
    archive = Archive(data)
    root = archive.xml("content.xml")
    body = next(root.all("text"), None) if root is not None else None
    if body is None:
        raise DocumentError("unsupported", "no text body")
    out: list[str] = []

    def flow(node: Node, depth: int) -> None:
        for c in node.children:
            if c.name == "h":
                out.append("#" * max(1, min(6, int(c.get("outline-level", "1") or 1))) + " " + _odf_text(c))
            elif c.name == "p":
                text = _odf_text(c)
                if text:
                    out.append("  " * (depth - 1) + "- " + text if depth else text)
            elif c.name == "list":
                at = len(out)
                for item in c.children:
                    flow(item, depth + 1)
                out[at:] = ["\n".join(out[at:])] if len(out) > at else []
            elif c.name == "table":
                out.append(pipe_table(_odf_rows(c)))
            elif c.name in ("section", "text-box", "frame"):
                flow(c, depth)

    flow(body, 0)
    return {"markdown": tidy("\n\n".join(out)).strip(), "metadata": core_properties(archive), "stats": {}, "images": media(archive, "Pictures/")}


def _odf_text(node: Node) -> str:
    out = []
    for c in node.children:
        if c.name == "#text":
            out.append(c.text)
        elif c.name == "s":
            out.append(" " * int(c.get("c", "1") or 1))
        elif c.name == "tab":
            out.append("\t")
        elif c.name == "line-break":
            out.append("  \n")
        elif c.name == "a":
            out.append(f"[{_odf_text(c)}]({c.get('href')})")
        else:
            out.append(_odf_text(c))
    return "".join(out).strip() if node.name in ("p", "h") else "".join(out)


def _odf_rows(table: Node) -> list[list[str]]:
    rows = []
    for r in table.all("table-row"):
        cells: list[str] = []
        for c in r.children:
            if c.name in ("table-cell", "covered-table-cell"):
                text = " ".join(_odf_text(p) for p in c.all("p"))
                times = int(c.get("number-columns-repeated", "1") or 1)
                cells += [text] * (times if text else min(times, 1024))
        while cells and not cells[-1]:
            cells.pop()
        times = int(r.get("number-rows-repeated", "1") or 1)
        rows += [cells] * (times if cells else min(times, 1))
    while rows and not rows[-1]:
        rows.pop()
    width = max(map(len, rows), default=0)
    return [[*r, *[""] * (width - len(r))] for r in rows]


# ---------------------------------------------------------------- spreadsheets

def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _xlsx_sheets(archive: Archive):
    shared = archive.xml("xl/sharedStrings.xml")
    strings = ["".join(t.deep_text() for t in si.all("t")) for si in shared.children if si.name == "si"] if shared is not None else []
    book = archive.xml("xl/workbook.xml")
    if book is None:
        raise DocumentError("unsupported", "no workbook part")
    targets = archive.relations("xl/workbook.xml")
    for sheet in book.all("sheet"):
        target = targets.get(sheet.get("id"), "")
        root = archive.xml(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
        grid: list[list[str]] = []
        for row in root.all("row") if root is not None else ():
            at = int(row.get("r", "0") or 0) or len(grid) + 1
            while len(grid) < at - 1 and at < 1 << 20:
                grid.append([])
            cells: list[str] = []
            for c in row.children:
                if c.name != "c":
                    continue
                k = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [""] * (k - len(cells))
                value, kind = c.child("v"), c.get("t")
                text = value.deep_text() if value is not None else ""
                if kind == "s" and text.isdigit() and int(text) < len(strings):
                    text = strings[int(text)]
                elif kind == "inlineStr":
                    text = "".join(t.deep_text() for t in c.all("t"))
                elif kind == "b":
                    text = "True" if text == "1" else "False"
                cells.append(text)
            grid.append(cells)
        width = max(map(len, grid), default=0)
        yield sheet.get("name"), [[*r, *[""] * (width - len(r))] for r in grid]


def _ods_sheets(archive: Archive):
    root = archive.xml("content.xml")
    for t in root.all("table") if root is not None else ():
        yield t.get("name"), _odf_rows(t)


def workbook(data: bytes, cap: int, structured: bool) -> dict:
    archive = Archive(data)
    sheets = list(_ods_sheets(archive) if "content.xml" in archive.names else _xlsx_sheets(archive))
    text = "\n\n".join(f"## {name}\n\n{pipe_table(rows)}".strip() for name, rows in sheets)
    meta = core_properties(archive) | {"sheet_count": len(sheets)}
    out = {"markdown": tidy(text).strip(), "metadata": meta, "stats": {}}
    if structured:
        meta["sheet_names"] = [n for n, _ in sheets]
        out["sheets"] = [{"name": n, "rows": rows[:cap], "truncated": len(rows) > cap} for n, rows in sheets]
    return out


# ---------------------------------------------------------------- presentations

def _frames(root: Node | None) -> list[str]:
    out = []
    for body in root.all("txBody") if root is not None else ():
        text = "\n".join("".join("\n" if t.name == "br" else t.deep_text() for t in p.all("t", "br")) for p in body.children if p.name == "p").strip()
        if text:
            out.append(text)
    return out


def _pptx_slides(archive: Archive):
    for name in archive.numbered(r"ppt/slides/slide(\d+)\.xml"):
        root = archive.xml(name)
        parts = []
        for shape in root.all("sp", "graphicFrame"):
            if shape.name == "graphicFrame":
                rows = [["\n".join(_frames_of_cell(c)) for c in r.children if c.name == "tc"] for r in shape.all("tr")]
                if rows:
                    parts.append(("table", pipe_table(rows)))
                continue
            title = any(p.get("type") in ("title", "ctrTitle") for p in shape.all("ph"))
            parts += [("title" if title else "text", t) for t in _frames(shape)]
        notes = next((archive.xml(f"ppt/{t.removeprefix('../')}") for t in archive.relations(name).values() if "notesSlide" in t), None)
        yield parts, "\n".join(t for t in _frames(notes) if not t.isdigit())


def _frames_of_cell(cell: Node) -> list[str]:
    return ["".join(t.deep_text() for t in p.all("t")) for p in cell.all("p")]


def _odp_slides(archive: Archive):
    root = archive.xml("content.xml")
    for page in root.all("page") if root is not None else ():
        notes = page.child("notes")
        said = "\n".join(_odf_text(p) for p in notes.all("p")) if notes is not None else ""
        parts = []
        for frame in page.children:
            if frame.name == "frame":
                text = "\n".join(x for p in frame.all("p", "h") if (x := _odf_text(p)))
                if text:
                    parts.append(("title" if frame.get("class") == "title" else "text", text))
        yield parts, said.strip()


def presentation(data: bytes, structured: bool) -> dict:
    archive = Archive(data)
    slides = list(_odp_slides(archive) if "content.xml" in archive.names else _pptx_slides(archive))
    out = []
    for n, (parts, notes) in enumerate(slides, 1):
        body = "\n\n".join(f"# {t}" if kind == "title" else t for kind, t in parts)
        out.append(f"<!-- Slide number: {n} -->\n{body}" + (f"\n\n### Notes:\n{notes}" if notes else ""))
    found = {"markdown": tidy("\n\n".join(out)).strip(), "metadata": core_properties(archive) | {"slide_count": len(slides)}, "stats": {}, "images": media(archive, "ppt/media/")}
    if structured:
        found["slides"] = [{"slide": n, "text": "\n".join(t for _, t in parts), "notes": notes} for n, (parts, notes) in enumerate(slides, 1)]
    return found
