"""The registered queries on the test tables, and the pipeline stage by stage."""

import hashlib
import os
import re
import struct

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
import public_tokenizers
from shoalkv.llm import mixing, near, quality, registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def texts(frame):
    names = sorted(frame.columns)
    shown = frame[names].astype(object).where(frame[names].notna(), None).astype(str)
    return sorted([[x.removesuffix(".0") for x in r] for r in shown.values.tolist()])  # pandas shows nullable integers as floats


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and texts(got) == texts(want)


def test_every_operator_is_registered():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = registry.QUERIES["op10_langid"](spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert got and sum(r.lang == r.lang_pred for r in got) / len(got) >= 0.95


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    columns, before = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DATA).cache()
        assert after.columns == columns
        kept[name] = {r.doc_id: r for r in after.collect()}
        assert set(kept[name]) <= {r.doc_id for r in before.select("doc_id").collect()} and kept[name]
        before = after
    brute = {r.doc_id for r in docs.collect() if quality.verdict((r.text or "").encode())[6]}
    assert set(kept["quality"]) == brute
    first = {}
    for i in sorted(brute):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept["quality"][i].text), i)
    assert set(kept["exact_dedup"]) == set(first.values())
    # Near copies: every pair looked at.
    rows = [(r.doc_id, r.text) for r in kept["exact_dedup"].values()]
    memo = near._Hashes()
    sets = [near.shingled((t or "").encode(), memo) for _, t in rows]
    bands, prints = [near.bands(h) for h in sets], np.array([np.frombuffer(near.sketch(h), np.uint64) for h in sets])
    label = list(range(len(rows)))
    for i in range(len(rows)):
        alike = near.similar(prints[:i], prints[i], 0.8 - near.SLACK)
        for j in np.flatnonzero(alike).tolist():
            if any(x == y for x, y in zip(bands[i], bands[j], strict=True)):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    least = {}
    for (doc_id, _), x in zip(rows, label, strict=True):
        least[x] = min(doc_id, least.get(x, doc_id))
    assert set(kept["near_dedup"]) == set(least.values()) and len(least) < len(rows)
    # Mixing: in SQL.
    con = duckdb.connect()
    docs.where(F.col("doc_id").isin(list(kept["near_dedup"]))).toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = sorted(r[0] for r in con.sql("SELECT doc_id FROM (" + mixing.mix_sql(90, 1).strip() + ")").fetchall())
    assert sorted(kept["mixing"]) == want and len(want) < len(least)
    # Encoding: by tiktoken.
    last = corpus_pipeline.STAGES[-1][1](spark, before, DATA).collect()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=registry.codec().ranks, special_tokens={})
    ids = {i: own.encode_ordinary(r.text or "") for i, r in kept["mixing"].items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in last} == {i: (len(x), hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest()) for i, x in ids.items()}
    assert all(r.decoded_sha256 == hashlib.sha256((kept["mixing"][r.doc_id].text or "").encode()).hexdigest() for r in last)
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, docs.collect()))
