import math
import os
import re
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from docmill import catalog


@pytest.fixture(scope="module")
def oracle(sf_dir):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for x in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {x.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{x}'")
    return c


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_statement(spark, oracle, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    found = oracle.sql(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert got == want and got


def test_every_query_has_a_statement():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) <= {"convert_pages", "pdf_layout"}


def test_gaps_that_the_last_bit_puts_above_five(spark, tmp_path):
    prices = [3.3, 8.3, 45.3, 90.5]
    assert 8.3 - 3.3 > 5
    spark.createDataFrame([(1, x) for x in prices], "o_custkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    want = duckdb.sql(catalog.ORACLES["adaptive_gap"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")).fetchall()
    assert [tuple(r) for r in catalog.QUERIES["adaptive_gap"](spark, str(tmp_path)).collect()] == want == [(1, 35.0)]


def test_the_last_step_of_pdf_layout_reads_pages_and_no_words(spark, sf_dir):
    plan = catalog.QUERIES["pdf_layout"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "documents.parquet" not in plan


def test_pdf_layout_writes_texts_of_pages_and_moves_nothing(spark, sf_dir):
    from docmill.operators import layout as G
    from docmill.plans.store import shared_dir

    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    df = catalog.QUERIES["pdf_layout"](spark, sf_dir)
    assert [x.partition("-")[0] for x in set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before if x.count("-") == 1] == ["pages"]
    laid = G.page_texts(catalog.words(spark, sf_dir), together=True)
    assert not any("Exchange" in x._jdf.queryExecution().executedPlan().toString() for x in (df, laid))


def test_each_stage_of_pdf_layout_has_an_effect_and_no_word_is_lost(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = catalog.QUERIES["pdf_layout"](spark, sf_dir).collect()
    assert len(rows) == len(texts) and sum(r.page_count > 2 for r in rows) > 9 and sum(r.page_count < 3 for r in rows) > 9
    signs = re.compile(r"[\s#|-]|Running-head|Running-foot")
    for r in rows:
        words = re.split("[ \n]+", texts[r.doc_id])
        assert r.page_count == -(-len(words) // 120) and (r.garbage > 0) == (r.doc_id % 16 == 5 and len(r.markdown) > 99)
        assert "Letterhead" not in r.markdown and "Margin-label" not in r.markdown and "(cid:" not in r.markdown
        times = r.page_count if r.page_count < 3 else 0
        assert (r.markdown.count("Running-head"), r.markdown.count("Running-foot")) == (times, times)
        shown = re.sub(r"(?m)^## Page \d+$", "", r.markdown)
        assert Counter(signs.sub("", shown)) == Counter(signs.sub("", texts[r.doc_id]))
    assert any("| --" in r.markdown for r in rows) and any(re.search(r"(?m)^## (?!Page)", r.markdown) for r in rows)
    kinds = {r.layout for r in catalog.G.classified(catalog.G.cropped(catalog.page_words(spark, sf_dir))).select("layout").distinct().collect()}
    assert kinds == {"single", "prose_multi"}
