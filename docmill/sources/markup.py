"""HTML to GitHub-flavoured markdown with the standard library's tolerant parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

_SKIP = {"script", "style", "head", "title", "template", "noscript"}
_BLOCK = {"p", "div", "article", "section", "nav", "footer", "header", "main", "aside", "ul", "ol", "dl", "dt", "dd", "form", "figure", "figcaption", "address", "tr", "body"}
_MARK = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~"}


def tidy(text: str) -> str:
    """No white space at line ends, at most one empty line in a row."""
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in re.split(r"\r?\n", text)))


def pipe_table(rows: list[list[str]]) -> str:
    """The first row is the head; shorter rows are filled up."""
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    cell = lambda x: x.replace("\n", " ").replace("|", "\\|")
    line = lambda r: "| " + " | ".join([*map(cell, r), *[""] * (width - len(r))]) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])])


class Writer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = self.pre = 0
        self.lists: list[list] = []
        self.links: list[str] = []
        self.marks: list[tuple[str, int]] = []
        self.tables: list[list[list[str]]] = []
        self.cells: list[tuple[int, int]] = []
        self.title: str | None = None

    def block(self) -> None:
        text = "".join(self.out[-2:])
        if self.out and not text.endswith("\n\n"):
            self.out.append("\n\n")

    def close_cell(self) -> None:
        """Ends the open cell of the innermost table; end tags of cells may be missing."""
        if self.cells and self.cells[-1][0] == len(self.tables):
            _, at = self.cells.pop()
            text = re.sub(r"\s+", " ", "".join(self.out[at:])).strip()
            del self.out[at:]
            self.tables[-1][-1].append(text)

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag in _SKIP:
            self.skip += 1
            if tag == "title":
                self.title = self.title or ""
            return
        if self.skip:
            if tag != "body":
                return
            self.skip = 0
        if tag in _MARK:
            self.marks.append((tag, len(self.out)))
            self.out.append(_MARK[tag])
        elif re.fullmatch("h[1-6]", tag):
            self.block()
            self.out.append("#" * int(tag[1]) + " ")
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self.block()
            self.out.append("---\n\n")
        elif tag == "a":
            self.links.append(values.get("href") or "")
            self.out.append("[")
        elif tag == "img":
            self.out.append(f"![{values.get('alt') or ''}]({values.get('src') or ''})")
        elif tag in ("ul", "ol"):
            self.out.append("\n" if self.lists else "\n\n")
            self.lists.append([tag, 0])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif tag == "pre":
            self.block()
            self.out.append("```\n")
            self.pre += 1
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "blockquote":
            self.block()
            self.out.append("> ")
        elif tag == "table":
            self.block()
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.close_cell()
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            self.close_cell()
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cells.append((len(self.tables), len(self.out)))
        elif tag in _BLOCK:
            self.block()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in _SKIP:
            self.skip -= 1

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag in _MARK:
            if self.marks and self.marks[-1][0] == tag:
                at = self.marks.pop()[1]
                text = "".join(self.out[at + 1 :])
                body = text.strip()
                lead, tail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
                self.out[at:] = [lead + _MARK[tag] + body + _MARK[tag] + tail if body else text]
        elif re.fullmatch("h[1-6]", tag) or tag in _BLOCK and tag not in ("ul", "ol", "tr"):
            self.block()
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            if not self.lists:
                self.block()
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("td", "th") and self.tables:
            self.close_cell()
        elif tag == "table" and self.tables:
            self.close_cell()
            rows = [r for r in self.tables.pop() if r]
            if rows:
                self.out.append(pipe_table(rows) + "\n\n")

    def handle_data(self, data):
        if self.skip:
            if self.title is not None and self.lasttag == "title":
                self.title += data
            return
        if not self.pre:
            data = re.sub(r"[ \t\r\n\f]+", " ", data)
            if data.startswith(" ") and (not self.out or self.out[-1].endswith(("\n", " ", "[", "# ", "> "))):
                data = data[1:]
        if data:
            self.out.append(data)

    def markdown(self) -> str:
        for _, at in self.marks:  # never closed
            self.out[at] = ""
        while self.tables:
            self.handle_endtag("table")
        return tidy("".join(self.out)).strip()


def html_to_markdown(html: str) -> tuple[str, str | None]:
    """(markdown, title)."""
    w = Writer()
    w.feed(html)
    w.close()
    return w.markdown(), (w.title or "").strip() or None
