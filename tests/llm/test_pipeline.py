import corpus_pipeline
import numpy as np
from tests.llm.helpers import normalised, shingles

import __spark_entry__


def test_stages_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "exact_dedup", "near_dedup", "packing"]
    found = __spark_entry__.queries()
    assert found["pipeline"].__wrapped__ is corpus_pipeline.run
    assert sorted(int(n[2:].split("_")[0]) for n in found if n.startswith("op")) == list(range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(found)


def test_stages_do_what_their_operators_say(spark):
    from docmill.llm import quality, toxicity
    from docmill.llm.common import written

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], (
        lambda d: {r.doc_id for r in toxicity.toxicity(d, labels).where("predicted = 0").collect()},
        lambda d: {r.doc_id for r in quality.quality(d, labels).where("predicted = 1").collect()},
        lambda d: _first(d, lambda a, b: normalised(a) == normalised(b)),
        _unlinked,
    ), strict=True):
        out = written(stage(spark, docs, sf), name)
        assert out.columns == docs.columns, name
        assert {r.doc_id for r in out.select("doc_id").collect()} == want(docs), name
        assert 0 < out.count() < docs.count() or name == "near_dedup"
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.select("doc_id").collect()}
    sums = {}
    for r in pieces:
        sums[r.sequence_id] = sums.get(r.sequence_id, 0) + r.length
    assert max(sums.values()) <= 4096 and len(sums) <= 1.01 * np.ceil(sum(sums.values()) / 4096) + 1


def test_stages_on_an_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == [], name


def _first(d, same):
    seen = {}
    for r in sorted(d.collect(), key=lambda r: r.doc_id):
        seen.setdefault(normalised(r.text), r.doc_id)
    return set(seen.values())


def _unlinked(d):
    rows = sorted((r.doc_id, frozenset(shingles(r.text, 5))) for r in d.collect())
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, s) in enumerate(rows):
        for j, t in rows[a + 1 :]:
            if s and t and min(len(s), len(t)) >= 0.8 * max(len(s), len(t)) and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i for i, _ in rows if root(i) == i}


def test_entry_imports_without_the_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(corpus_pipeline.__file__).parent
    shutil.copytree(repo / "docmill", tmp_path / "docmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n.startswith('op')])"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0 and said.stdout.strip().endswith("[]"), said.stderr
