"""The pipeline on a small corpus: each stage's decisions, by brute force on its own input."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline as P
from pyspark.sql import functions as F
from tests.llm.test_linededup import brute as lines
from tests.llm.test_minhash import brute as groups
from tests.llm.test_packing import bpe, check  # noqa: F401

#: Columns of users under names that the stages use themselves.
CLASHES = "rate target source_size _source _copy size again _again gone _gone removed n_lines _id _th _ci starts salt score component_id kept sig _user0 _user3 _row".split()


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    rng = np.random.default_rng(8)
    stock = [f"word{k}" for k in range(500)]
    rows, labels = [], []
    for i in range(160):
        text = "\n".join(" ".join(rng.choice(stock, int(rng.integers(4, 12)))) for _ in range(int(rng.integers(1, 9))))
        toxic = i % 4 == 0
        rows.append((i, f"vile rotten {text} awful" if toxic else text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    passage = "\n".join(" ".join(rng.choice(stock, 20)) for _ in range(3))
    rows += [(200 + k, f"first {k}\n{passage}\nlast {k} " + " ".join(rng.choice(stock, 30)), "en", "s1", 1) for k in range(3)]
    rows += [(300 + k, rows[9][1] if k else rows[9][1] + " more", "en", "s0", 1) for k in range(3)]
    line = " ".join(rng.choice(stock, 60))
    rows += [(310 + k, f"{line} end{k}", "en", "s0", 1) for k in range(4)]
    rows += [(400, None, "en", None, None), (401, "", "en", "s2", 0)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, folder, tmp_path, bpe):  # noqa: F811
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.select("lang", *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHES), "doc_id", "text", "source", "n_chars")
    docs = docs.unionByName(docs.where("doc_id = 5"))
    for k, (name, stage) in enumerate(P.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, folder)
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        after = out.collect()
        ids = {r.doc_id for r in after}
        if name != "packing":
            assert all(r[c] == f"{c}:{r.doc_id}" for r in after for c in CLASHES)
        if name == "toxicity":
            assert ids == {i for i in before if not (i < 160 and i % 4 == 0)}
        elif name == "line_dedup":
            want = lines([(i, r.text) for i, r in before.items()])
            got = {r.doc_id: r.text for r in after}
            assert got == {i: (want[i][0] if i in want else None) for i in before if i not in want or want[i][0].strip() or not want[i][1]}
            assert sum(len(want[i][1]) for i in (200, 201, 202)) == 6
        elif name == "minhash":
            root = groups([(i, r.text) for i, r in before.items()])
            assert ids == {i for i in before if root[i] == i} and len(after) == len(ids)
            assert before.keys() - ids
        elif name == "mixing":
            n = {i: sum(r.doc_id == i for r in after) for i in before}
            assert max(n.values()) <= 3 and all(r.text == before[r.doc_id].text for r in after)
        else:
            assert ids == set(before)
            assert check(rows, after, bpe, 2048) < 0.2
        docs = out


def test_run(spark, folder):
    out = P.run(spark, folder)
    assert out.count() > 0 and "sequence_id" in out.columns
    assert 4 <= len(P.STAGES) <= 5 and P.ORACLE_SQL is None


def test_no_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false").withColumn("rate", F.lit(1))
    for name, stage in P.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
