"""Small files of every format, built with the standard library."""

import io
import struct
import zipfile
import zlib
from email.message import EmailMessage

W = 'xmlns:w="http://w" xmlns:r="http://r" xmlns:m="http://m"'
A = 'xmlns:a="http://a" xmlns:p="http://p" xmlns:r="http://r"'
CORE = '<cp:coreProperties xmlns:cp="http://c" xmlns:dc="http://d" xmlns:dcterms="http://t"><dc:title>Quarterly Report</dc:title><dc:creator>Finance Team</dc:creator><dcterms:created>2024-01-15T09:30:00Z</dcterms:created></cp:coreProperties>'


def archive(members: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def png(width=320, height=80) -> bytes:
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    rows = b"".join(b"\0" + b"\xff" * (width * 3) for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def docx() -> bytes:
    body = f"""<w:document {W}><w:body>
      <w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Quarterly Report</w:t></w:r></w:p>
      <w:p><w:r><w:t xml:space="preserve">Plain </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:ins w:id="1" w:author="A &amp; B" w:date="2024-01-15T09:30:00Z"><w:r><w:t xml:space="preserve"> added</w:t></w:r></w:ins><w:del><w:r><w:delText xml:space="preserve"> gone</w:delText></w:r></w:del></w:p>
      <w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>one</w:t></w:r></w:p>
      <w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:hyperlink r:id="L"><w:r><w:t>two</w:t></w:r></w:hyperlink></w:p>
      <w:tbl><w:tr><w:tc><w:p><w:r><w:t>Metric</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>Value</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>Revenue</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>100</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
      <w:p><w:r><w:t xml:space="preserve">so </w:t></w:r><m:oMath><m:f><m:num><m:r><m:t>a</m:t></m:r></m:num><m:den><m:r><m:t>b</m:t></m:r></m:den></m:f></m:oMath></w:p>
      <w:p><m:oMathPara><m:oMath><m:sSup><m:e><m:r><m:t>x</m:t></m:r></m:e><m:sup><m:r><m:t>2</m:t></m:r></m:sup></m:sSup></m:oMath></m:oMathPara></w:p>
      </w:body></w:document>"""
    styles = f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    numbering = f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>'
    rels = '<Relationships xmlns="http://x"><Relationship Id="L" Target="https://example.com"/></Relationships>'
    return archive({"word/document.xml": body, "word/styles.xml": styles, "word/numbering.xml": numbering, "word/_rels/document.xml.rels": rels, "docProps/core.xml": CORE, "word/media/a.png": png(), "word/media/b.png": png(), "word/media/c.png": png(40, 40)})


def pptx() -> bytes:
    shape = lambda kind, *ps: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody>' + "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in ps) + "</p:txBody></p:sp>"
    slide = f"<p:sld {A}><p:cSld><p:spTree>{shape('title', 'Deck Title')}{shape('body', 'first point', 'second point')}</p:spTree></p:cSld></p:sld>"
    notes = f"<p:notes {A}>{shape('body', 'say hello')}</p:notes>"
    return archive({"ppt/slides/slide1.xml": slide, "ppt/slides/_rels/slide1.xml.rels": '<Relationships xmlns="http://x"><Relationship Id="n" Target="../notesSlides/notesSlide1.xml"/></Relationships>', "ppt/notesSlides/notesSlide1.xml": notes, "docProps/core.xml": CORE})


def xlsx() -> bytes:
    s = "http://s"
    book = f'<workbook xmlns="{s}" xmlns:r="http://r"><sheets><sheet name="Sales" r:id="r1"/></sheets></workbook>'
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Total</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>42</v></c></row><row r="4"><c r="B4"><v>58</v></c></row>'
    return archive({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>Region</t></si><si><r><t>No</t></r><r><t>rth</t></r></si></sst>', "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{s}"><sheetData>{rows}</sheetData></worksheet>', "docProps/core.xml": CORE})


O = 'xmlns:office="http://o" xmlns:text="http://t" xmlns:table="http://b" xmlns:draw="http://d" xmlns:xlink="http://l"'


def odt() -> bytes:
    return archive({"content.xml": f'<office:document-content {O}><office:body><office:text><text:h text:outline-level="1">Open Title</text:h><text:p>Open paragraph.</text:p><text:list><text:list-item><text:p>item</text:p></text:list-item></text:list></office:text></office:body></office:document-content>'})


def ods() -> bytes:
    cell = lambda t: f"<table:table-cell><text:p>{t}</text:p></table:table-cell>"
    row = lambda *c: "<table:table-row>" + "".join(map(cell, c)) + "</table:table-row>"
    return archive({"content.xml": f'<office:document-content {O}><office:body><office:spreadsheet><table:table table:name="Tab">{row("a", "b")}{row("1", "2")}{row("3", "4")}</table:table></office:spreadsheet></office:body></office:document-content>'})


def odp() -> bytes:
    return archive({"content.xml": f"<office:document-content {O}><office:body><office:presentation><draw:page><draw:frame><draw:text-box><text:p>slide one</text:p><text:p>more</text:p></draw:text-box></draw:frame></draw:page></office:presentation></office:body></office:document-content>"})


def pdf(pages=2, lines=15, encrypted=False, body=None) -> bytes:
    """Fonts of 500/1000 wide letters; `body` gives content streams."""
    sentence = "This sentence number {} carries enough words to count as a paragraph of a page."
    streams = body or [b"BT /F1 10 Tf 72 700 Td 14 TL " + b"".join(b"(" + sentence.format(p * lines + i).encode() + b") Tj T* " for i in range(lines)) + b"ET" for p in range(pages)]
    n = len(streams)
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(n)) + b"] /Count %d /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> >>" % n, 3: b"<< /Type /Font /Subtype /Type1 /FirstChar 32 /Widths [" + b" 500" * 95 + b"] >>", 4: b"<< /Title (Test \\(PDF\\)) /Author <FEFF00C9> /CreationDate (D:20240115093000+05'00') /Creator (Microsoft Word) >>"}
    for i, s in enumerate(streams):
        packed = zlib.compress(s)
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream"
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % k + v + b"\nendobj\n" for k, v in objects.items())
    return out + b"trailer << /Root 1 0 R /Info 4 0 R " + (b"/Encrypt << /V 1 >> " if encrypted else b"") + b">>\n%%EOF"


def eml() -> bytes:
    m = EmailMessage()
    m["Subject"], m["From"], m["To"], m["Message-ID"], m["Date"] = "Grüße aus Köln", "alice@example.com", "bob@example.com", "<abc123@example.com>", "Mon, 15 Jan 2024 09:30:00 +0000"
    m.set_content("Hello Bob,\nsee the file.")
    m.add_alternative("<p>Hello <b>Bob</b></p>", subtype="html")
    m.add_attachment(b"x" * 3000, maintype="application", subtype="octet-stream", filename="data.bin")
    return bytes(m)


def mbox(n=2) -> bytes:
    return b"".join(f"From a@b Mon Jan 15 09:30:00 2024\nSubject: Note {i}\nFrom: a@b\nTo: c@d\n\nBody {i}\n>From here\n\n".encode() for i in range(1, n + 1))


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file, all streams (under 4096 bytes each) in the mini stream."""
    mini, starts, table = b"", {}, []
    for k, v in streams.items():
        starts[k] = len(mini) // 64
        blocks = -(-len(v) // 64)
        table += [*range(starts[k] + 1, starts[k] + blocks), 0xFFFFFFFE]
        mini += v.ljust(64 * blocks, b"\0")

    def entry(name, kind, child=0xFFFFFFFF, right=0xFFFFFFFF, start=0xFFFFFFFE, size=0):
        raw = (name + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, 0xFFFFFFFF, right, child) + bytes(36) + struct.pack("<IQ", start, size)

    names = list(streams)
    sectors = lambda n: -(-n // 512)
    # sectors: 0 FAT, then the directory, the mini stream, the mini FAT
    sizes = [sectors(128 * (len(names) + 1)), sectors(len(mini)), sectors(4 * len(table))]
    at = [1, 1 + sizes[0], 1 + sizes[0] + sizes[1]]
    directory = entry("Root Entry", 5, 1, start=at[1], size=len(mini)) + b"".join(entry(k, 2, right=i + 2 if i + 1 < len(names) else 0xFFFFFFFF, start=starts[k], size=len(streams[k])) for i, k in enumerate(names))
    fat = [0xFFFFFFFD] + [x for first, n in zip(at, sizes, strict=True) for x in [*range(first + 1, first + n), 0xFFFFFFFE]]
    numbers = lambda xs: struct.pack(f"<{len(xs)}I", *xs).ljust(512 * sectors(4 * len(xs)), b"\xff")
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<9I", 0, 1, 1, 0, 4096, at[2], sizes[2], 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return head + numbers(fat) + directory.ljust(512 * sizes[0], b"\0") + mini.ljust(512 * sizes[1], b"\0") + numbers(table)


def msg() -> bytes:
    return compound({"__substg1.0_0037001F": "Topic".encode("utf-16-le"), "__substg1.0_1000001F": "The body.".encode("utf-16-le"), "__substg1.0_0C1A001F": "Alice".encode("utf-16-le"), "__substg1.0_0E04001F": "Bob".encode("utf-16-le")})


def summary() -> bytes:
    """Title and time of making."""
    title = struct.pack("<II", 30, 8) + b"Old one\0"
    made = struct.pack("<IQ", 64, 133497702000000000)
    values = struct.pack("<IIIIII", 24 + len(title) + len(made), 2, 2, 24, 12, 24 + len(title)) + title + made
    return struct.pack("<HHI", 0xFFFE, 0, 0) + bytes(16) + struct.pack("<I", 1) + bytes(16) + struct.pack("<I", 48) + values


def doc() -> bytes:
    one, two = "First par\x0bagraph.\rSee \x13 HYPERLINK x \x14the site\x15 now.\rName\x07Caf\xe9\x07\x07nut\x075\x07\x07".encode("cp1252"), "Λast.\r".encode("utf-16-le")
    n = len(one), len(two) // 2
    body = bytearray(0x200)
    body[:2], body[10:12] = b"\xec\xa5", struct.pack("<H", 0x200)
    body[0x4C:0x50] = struct.pack("<I", sum(n))
    clx = b"\x01\x02\x00ab\x02" + struct.pack("<I", 12 + 16) + struct.pack("<3I", 0, n[0], sum(n)) + struct.pack("<HIH", 0, 0x200 * 2 | 0x40000000, 0) + struct.pack("<HIH", 0, 0x200 + n[0], 0)
    body[0x1A2:0x1AA] = struct.pack("<II", 4, len(clx))
    return compound({"WordDocument": bytes(body) + one + two, "1Table": b"pad." + clx, "\x05SummaryInformation": summary()})


def xls() -> bytes:
    record = lambda kind, body=b"": struct.pack("<HH", kind, len(body)) + body
    cell = lambda y, x, rest, style=0: struct.pack("<HHH", y, x, style) + rest
    short = lambda t: struct.pack("<BB", len(t), 0) + t.encode()
    bof = record(0x809, struct.pack("<HHHH", 0x600, 5, 0, 0))
    strings = struct.pack("<II", 3, 3) + struct.pack("<HB", 5, 0) + b"Month" + struct.pack("<HBH", 4, 9, 1) + "Σale".encode("utf-16-le") + bytes(4) + struct.pack("<HB", 6, 0) + b"Jan"
    start = bof + record(0x41E, struct.pack("<HHB", 164, 10, 0) + b"yyyy-mm-dd") + record(0xE0, struct.pack("<HH", 0, 0) + bytes(16)) + record(0xE0, struct.pack("<HH", 0, 164) + bytes(16))
    rest = record(0xFC, strings) + record(0x3C, b"\0uar") + record(0x0A)
    sheet = record(0x85, struct.pack("<IBB", 0, 0, 0) + short("Old"))
    where = len(start) + len(sheet) + len(rest)
    rows = [record(0xFD, cell(0, 0, struct.pack("<I", 0))), record(0xFD, cell(0, 1, struct.pack("<I", 1))), record(0xFD, cell(1, 0, struct.pack("<I", 2))), record(0x203, cell(1, 1, struct.pack("<d", 2.5)))]
    rows += [record(0xBD, struct.pack("<HHHIHIH", 2, 0, 0, 7 << 2 | 2, 0, 725 << 2 | 3, 1)), record(0x203, cell(3, 0, struct.pack("<d", 45306.0), 1)), record(0x06, cell(3, 1, b"\0" * 6 + b"\xff\xff" + bytes(8))), record(0x207, struct.pack("<HB", 2, 0) + b"hi"), record(0x205, cell(4, 1, b"\1\0"))]
    return compound({"Workbook": start + record(0x85, struct.pack("<IBB", where, 0, 0) + short("Old")) + rest + bof + b"".join(rows) + record(0x0A), "\x05SummaryInformation": summary()})


def ppt() -> bytes:
    atom = lambda kind, body: struct.pack("<HHI", 0, kind, len(body)) + body
    box = lambda kind, body, instance=0: struct.pack("<HHI", instance << 4 | 15, kind, len(body)) + body
    title, text = atom(0x0F9F, struct.pack("<I", 0)), atom(0x0F9F, struct.pack("<I", 1))
    listed = box(0x0FF0, atom(0x03F3, bytes(20)) + title + atom(0x0FA8, b"Old deck") + text + atom(0x0FA0, "one\rtwö".encode("utf-16-le")) + atom(0x03F3, bytes(20)))
    slides = box(0x03EE, b"") + box(0x03EE, box(0x040C, text + atom(0x0FA8, b"a box")))
    notes = box(0x03F0, box(0x040C, text + atom(0x0FA8, b"say this"))) + box(0x03F0, box(0x040C, text + atom(0x0FA8, b"2")))
    return compound({"PowerPoint Document": box(0x03E8, box(0x03F8, text + atom(0x0FA8, b"of the master")) + listed) + slides + notes})


def folder(at) -> dict:
    """Writes a file of each kind below `at`; name -> bytes."""
    files = {
        "a.docx": docx(), "b.pptx": pptx(), "c.xlsx": xlsx(), "d.csv": b"name,score\nalice,90\nbob,75\n", "e.tsv": b"a\tb\n1\t2\t3\t4\n", "f.eml": eml(), "g.msg": msg(), "h.mbox": mbox(),
        "i.png": png(), "j.txt": "﻿café au lait  \n\n\n\nend".encode(), "k.md": b"# Head\n\n**bold**", "l.html": b"<title>T</title><h1>Title</h1><p>Hello <b>world</b></p><ul><li>one<li>two</ul><script>var p = '</p>';</script>",
        "m.rtf": rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}hello \b world\b0\par caf\'e9 \u8364?}", "n.json": b'{"name":"mill","sizes":[3,"b"]}', "o.json": b"{not json", "p.pdf": pdf(), "q.odt": odt(), "r.ods": ods(), "s.odp": odp(),
        "t.doc": b"\xd0\xcf", "old.doc": doc(), "old.xls": xls(), "old.ppt": ppt(), "u.xyz": b"?", "v.mbox": b"no mailbox", "w.pdf": pdf(encrypted=True), "x.pdf": pdf(1, 1), "y.txt": b" ", "z.csv": b"\n", "noext": b"x", "lat.txt": b"caf\xe9",
        "bomb.docx": archive({"word/document.xml": b"<a/>", "big": bytes(5 << 20)}), "xxe.docx": archive({"word/document.xml": '<!DOCTYPE x [<!ENTITY e SYSTEM "file:///etc/passwd">]><x>&e;</x>'}),
    }
    for name, data in files.items():
        (at / name).write_bytes(data)
    return files
