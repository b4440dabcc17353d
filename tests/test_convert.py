import json
import threading

import pytest
from pyspark.sql import functions as F

from docmill import registry
from docmill.conf import Settings, checked_mode
from docmill.plans import pipeline
from docmill.sources import files

from . import fixtures


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    fixtures.folder(at)
    return str(at)


@pytest.fixture(scope="module")
def results(spark, folder):
    return {r.filename: r for r in pipeline.convert(files.scan(spark, folder), "both", Settings(zip_max_total_mb=4)).collect()}


def test_every_file_gives_one_row(results, folder):
    import os

    assert set(results) == set(os.listdir(folder))


@pytest.mark.parametrize(("name", "status", "kind"), [("t.doc", 500, "failed"), ("u.xyz", 415, "unsupported"), ("noext", 415, "unsupported"), ("v.mbox", 415, "invalid_mbox"), ("w.pdf", 415, "encrypted_pdf"), ("x.pdf", 422, "needs_ocr"), ("bomb.docx", 413, "decompression_bomb"), ("xxe.docx", 415, "unsupported")])
def test_failures(results, name, status, kind):
    r = results[name]
    assert (r.status, r.error_kind) == (status, kind) and r.markdown is None and r.error


@pytest.mark.parametrize(("name", "parser", "parts"), [
    ("a.docx", "docx", ["# Quarterly Report", 'Plain **bold**<span class="insertion" author="A &amp; B" date="2024-01-15T09:30:00Z"> added</span><span class="deletion"> gone</span>', "1. one\n2. [two](https://example.com)", "| Metric | Value |\n| --- | --- |\n| Revenue | 100 |", "so $`\\frac{a}{b}`$", "```math\n{x}^{2}\n```"]),
    ("b.pptx", "pptx", ["# Deck Title", "first point\nsecond point", "### Notes:\nsay hello"]),
    ("c.xlsx", "xlsx", ["## Sales", "| Region | Total |", "| North | 42 |", "|  | 58 |"]),
    ("d.csv", "csv", ["| name | score |\n| --- | --- |\n| alice | 90 |\n| bob | 75 |"]),
    ("e.tsv", "csv", ["| a | b |  |  |", "| 1 | 2 | 3 | 4 |"]),
    ("f.eml", "email", ["# Subject: Grüße aus Köln", "**From:** alice@example.com", "**Message-ID:** <abc123@example.com>", "Hello Bob,", "**Attachments:** data.bin (2 KB)"]),
    ("g.msg", "msg", ["# Subject: Topic", "**From:** Alice", "The body."]),
    ("h.mbox", "mbox", ["# Mailbox: h.mbox (2 messages)", "## Message 1", "# Subject: Note 2", "From here"]),
    ("i.png", "image", ["# Image: i.png"]),
    ("j.txt", "text", ["café au lait\n\nend"]),
    ("lat.txt", "text", ["café"]),
    ("k.md", "markdown", ["**bold**"]),
    ("l.html", "html", ["# Title", "Hello **world**", "- one\n- two"]),
    ("m.rtf", "rtf", ["hello world\n\ncafé €"]),
    ("n.json", "json", ['```json\n{\n  "name": "mill"']),
    ("o.json", "json", ["```\n{not json\n```"]),
    ("p.pdf", "pdf", ["## Page 1", "## Page 2", "This sentence number 29 carries"]),
    ("old.doc", "docx", ["First par\nagraph.\n\nSee the site now.", "| Name | Café |\n| --- | --- |\n| nut | 5 |\n\nΛast."]),
    ("old.xls", "xlsx", ["## Old", "| Month | Σale |", "| Januar | 2.5 |\n| 7 | 7.25 |\n| 2024-01-15 00:00:00 | hi |\n|  | True |"]),
    ("old.ppt", "pptx", ["<!-- Slide number: 1 -->\n# Old deck\n\none\ntwö\n\n### Notes:\nsay this\n\n<!-- Slide number: 2 -->\na box"]),
    ("q.odt", "docx", ["# Open Title", "Open paragraph.", "- item"]),
    ("r.ods", "xlsx", ["## Tab", "| 3 | 4 |"]),
    ("s.odp", "pptx", ["slide one\nmore"]),
    ("y.txt", "text", [""]),
    ("z.csv", "csv", [""]),
])
def test_markdown(results, name, parser, parts):
    r = results[name]
    assert (r.status, r.parser) == (200, parser), r.error
    for p in parts:
        assert p in r.markdown


def test_script_text_is_dropped(results):
    assert "var p" not in results["l.html"].markdown


def test_structured(results):
    s = {k: r.structured for k, r in results.items()}
    assert s["d.csv"].columns == ["name", "score"] and s["d.csv"].rows[0] == ["alice", "90"] and s["d.csv"].truncated is False
    assert [x.name for x in s["c.xlsx"].sheets] == ["Sales"] and s["c.xlsx"].sheets[0].rows[3] == ["", "58"]
    assert s["b.pptx"].slides[0].notes == "say hello"
    assert json.loads(s["n.json"].json)["name"] == "mill" and s["o.json"].raw == "{not json"
    assert [p.page for p in s["p.pdf"].pages] == [1, 2] and "number 15 " in s["p.pdf"].pages[1].markdown
    assert [m["index"] for m in s["h.mbox"].messages] == [1, 2] and s["h.mbox"].messages[0].mail.subject == "Note 1"
    assert s["f.eml"].mail.attachments[0].size == 3000
    assert s["k.md"].text == "# Head\n\n**bold**"


def test_metadata(results):
    m = {k: r.metadata for k, r in results.items()}
    assert (m["a.docx"].title, m["a.docx"].author, m["a.docx"].created) == ("Quarterly Report", "Finance Team", "2024-01-15T09:30:00Z")
    assert m["b.pptx"].slide_count == 1 and m["c.xlsx"].sheet_count == 1 and m["c.xlsx"].sheet_names == ["Sales"]
    assert (m["i.png"].width, m["i.png"].height, m["i.png"].image_format) == (320, 80, "PNG")
    assert (m["p.pdf"].page_count, m["p.pdf"].title, m["p.pdf"].author, m["p.pdf"].created) == (2, "Test (PDF)", "É", "2024-01-15T09:30:00")
    assert (m["old.doc"].title, m["old.doc"].created, m["old.xls"].sheet_names, m["old.ppt"].slide_count) == ("Old one", "2024-01-15T05:30:00Z", ["Old"], 2)
    assert m["h.mbox"].message_count == 2 and m["f.eml"].message_id == "<abc123@example.com>"
    assert m["d.csv"].row_count == 2 and m["p.pdf"].language == "en" and m["l.html"].title == "T"
    assert all(x.source == k for k, x in m.items() if x is not None)
    assert results["a.docx"].stats["found_inline"] == 1 and results["a.docx"].stats["found_block"] == 1


def test_modes(spark, folder):
    some = files.scan(spark, folder, "[cd].*")
    plain = {r.filename: r for r in pipeline.convert(some, "MARKDOWN").collect()}
    assert plain["d.csv"].structured is None and plain["c.xlsx"].metadata.sheet_names is None and plain["d.csv"].metadata.row_count is None
    only = {r.filename: r for r in pipeline.convert(some, "structured").collect()}
    assert only["d.csv"].markdown is None and only["d.csv"].structured.rows
    with pytest.raises(ValueError, match="mode"):
        checked_mode("bogus")


def test_size_limit_and_mime(spark, tmp_path):
    (tmp_path / "big.txt").write_bytes(b"x" * (1 << 20) + b"y")
    (tmp_path / "picture.pdf").write_bytes(fixtures.png())
    (tmp_path / "picture.jpeg").write_bytes(fixtures.png())
    got = {r.filename: r for r in pipeline.convert(files.scan(spark, str(tmp_path)), None, Settings(max_file_mb=1, verify_mime=True)).collect()}
    assert got["big.txt"].status == 413
    assert (got["picture.pdf"].ext, got["picture.pdf"].parser) == (".png", "image") and got["picture.jpeg"].ext == ".jpeg"


def test_scanner(spark, folder):
    some = files.scan(spark, folder, "[jk].*")
    assert {r.error_kind for r in pipeline.convert(some, None, Settings(scan_command="false")).collect()} == {"malicious_file"}
    assert {r.status for r in pipeline.convert(some, None, Settings(scan_command="true")).collect()} == {200}


def test_each_file_is_scanned_and_opened_once(spark, folder, tmp_path):
    log = tmp_path / "log"
    script = tmp_path / "scan.sh"
    script.write_text(f'#!/bin/sh\nwc -c < "$1" >> {log}\n')
    script.chmod(0o755)
    some = files.scan(spark, folder, "[abdfhkp].*")
    got = pipeline.convert(some, "both", Settings(scan_command=str(script), zip_max_total_mb=4))
    assert {r.status for r in got.collect()} == {200}
    assert sorted(map(int, log.read_text().split())) == sorted(r.length for r in some.collect())
    assert "MapInPandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_slots_bound_what_runs_at_once(tmp_path):
    import time

    from docmill.plans.isolate import slot

    now, most = [0], [0]

    def work():
        with slot(2):
            now[0] += 1
            most[0] = max(most[0], now[0])
            time.sleep(0.05)
            now[0] -= 1

    threads = [threading.Thread(target=work) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert most[0] <= 2


def test_a_child_does_not_keep_its_parents_slot():
    from docmill.plans.isolate import Child, slot

    child = Child(lambda: {"markdown": ""}, 5)
    for _ in range(3):  # with one slot, the second turn waited for ever while the child lived
        done = []

        def turn(done=done):
            with slot(1):
                done.append(child())

        t = threading.Thread(target=turn, daemon=True)
        t.start()
        t.join(5)
        assert done == [{"markdown": ""}]
    child.stop()


def test_settings_reach_the_layout(spark, folder):
    whole = pipeline.convert(files.scan(spark, folder, "p.pdf"), None, Settings(pdf_crop_right=0, pdf_crop_top=0)).first()
    assert len(whole.markdown) >= len(pipeline.convert(files.scan(spark, folder, "p.pdf"), None, Settings(pdf_crop_right=300)).first().markdown or "")


def test_embedded_images(spark, folder):
    seen = lambda data, label: "words in it"
    r = pipeline.convert(files.scan(spark, folder, "a.docx"), None, Settings(ocr_embedded=True, zip_max_total_mb=0), seen).first()
    assert "## Embedded image text\n\n### a.png\n\nwords in it" in r.markdown and "b.png" not in r.markdown and "c.png" not in r.markdown


def test_registered_format(spark, tmp_path, monkeypatch):
    (tmp_path / "x.upper").write_bytes(b"abc")
    monkeypatch.setitem(registry.FORMATS, ".upper", None)
    registry.register_format("upper", "upper", lambda data, ext, settings, structured: {"parser": "upper", "markdown": data.decode().upper()})
    r = pipeline.convert(files.scan(spark, str(tmp_path))).first()
    registry.KERNELS.pop("upper")
    assert (r.status, r.parser, r.markdown) == (200, "upper", "ABC")


def test_a_reader_that_hangs_or_dies_costs_one_row():
    import os
    import time

    from docmill.plans.isolate import Child

    child = Child(lambda x: (time.sleep(30) if x == 1 else os._exit(1) if x == 2 else None) or {"markdown": str(x)}, 1)
    assert child(0) == {"markdown": "0"}
    assert child(1)["error_kind"] == "timeout"
    assert child(2)["error_kind"] == "failed"
    assert child(3) == {"markdown": "3"}
    child.stop()


def test_mailbox_cap(spark, tmp_path):
    (tmp_path / "m.mbox").write_bytes(fixtures.mbox(5))
    one = len(pipeline.convert(files.scan(spark, str(tmp_path)), None).first().markdown) // 5
    r = pipeline.convert(files.scan(spark, str(tmp_path)), "both", Settings(mbox_max_chars=one * 3)).first()
    assert r.structured.truncated_after == len(r.structured.messages) < 5 and "output truncated" in r.markdown
    r = pipeline.convert(files.scan(spark, str(tmp_path)), None, Settings(mbox_max_chars=5)).first()
    assert r.error_kind == "invalid_mbox"
    r = pipeline.convert(files.scan(spark, str(tmp_path)), None, Settings(mbox_max_messages=2)).first()
    assert r.error_kind == "invalid_mbox"


def test_sinks_and_stream(spark, folder, tmp_path):
    from docmill.streaming import stream

    results = pipeline.convert(files.scan(spark, folder, "[jku].*"))
    assert {json.loads(r.value)["filename"] for r in pipeline.as_json(results).collect()} == {"j.txt", "k.md", "u.xyz"}
    assert [r.filename for r in pipeline.dead_letters(results).collect()] == ["u.xyz"]
    pipeline.write(results, str(tmp_path / "out"), str(tmp_path / "dead"))
    assert spark.read.parquet(str(tmp_path / "out")).where("ext = '.md'").count() == 1
    (tmp_path / "in").mkdir()
    for n in "jk":
        (tmp_path / "in" / f"{n}.txt").write_text(n)
    q = stream.start(spark, str(tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "c"), per_trigger=1)
    q.awaitTermination(120)
    assert sorted(r.markdown for r in spark.read.parquet(str(tmp_path / "s")).select("markdown").collect()) == ["j", "k"]


def test_command_line(folder, capsys):
    from pathlib import Path

    from docmill.cli import main

    assert main([]) == 2 and main(["--mode", "bogus", "x"]) == 2
    assert main(["--health"]) == 0 and main(["--formats"]) == 0
    capsys.readouterr()
    assert main([str(Path(folder) / "n.json"), "--mode", "both"]) == 0
    assert json.loads(capsys.readouterr().out)["status"] == 200
    assert main([str(Path(folder) / "u.xyz")]) == 1


def test_archive_scan(spark, folder):
    from docmill.cli import bench, health, with_raster_images

    assert health()["status"] == "ok"
    assert [r.raster_count for r in with_raster_images(spark, folder, 5).collect()] == [3]
    records = []
    report = {r.ext: r for r in bench(spark, folder, 2, Settings(), records).collect()}
    assert {r["filename"]: r["ok"] for r in records}["n.json"] and all(r["ms"] >= 0 for r in records) and json.dumps(records)
    assert report[".json"].ok == 2 and report[None].n >= 25


def test_length_filter_is_pushed(spark, folder):
    plan = files.scan(spark, folder).where(F.col("length") <= 100)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,100)" in plan
