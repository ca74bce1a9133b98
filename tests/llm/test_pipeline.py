"""The stages in order, each held against its operator's rule on its own input; and the SQL twins."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from fieldspark.llm import op03_divergence as op3
from fieldspark.llm.queries import SQL
from fieldspark.llm.store import keep, prepare
from tools.check import rows

from .helpers import near, words
from .test_passages import overlap, repeated_stretches
from .test_tokens_and_chat import check_packing, ids

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    prepare(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(keep(stage(spark, tables[-1], SF), name))
    assert all(t.columns == columns for t in tables[:-1])
    texts = [{r["doc_id"]: r["text"] for r in t.collect()} for t in tables[:-1]]
    good = {r["doc_id"] for r in op3.quality(docs).where("kept").collect()}
    assert texts[1] == {i: t for i, t in texts[0].items() if i in good}
    want = near(list(texts[1].items()), 5)
    assert texts[2] == {i: t for i, t in texts[1].items() if want[i] == i}
    spans = repeated_stretches(list(texts[2].items()))
    for i, t in texts[2].items():
        cut = spans.get((i, t), [])
        assert words(texts[3][i]) == [w for k, w in enumerate(words(t)) if not any(a <= k < b for a, b in cut)]
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(texts[4]) == {i for i, t in texts[3].items() if all(overlap(words(t), s) is None for s in items)}
    packed = tables[5].collect()
    assert {r["doc_id"] for r in packed} == set(texts[4])
    assert sum(r["length"] for r in packed) == sum(len(ids(t)) + 1 for t in texts[4].values())
    assert check_packing(packed, 2048) <= -(-sum(r["length"] for r in packed) // 2048) + 1


def test_run_gives_the_last_stage(spark):
    assert entry.queries()["pipeline"](spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, SF)
    cursor = con.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns) and rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cursor.fetchall())


@pytest.mark.parametrize("number", range(1, 11))
def test_every_operator_has_a_query(number):
    assert sum(name.startswith(f"op{number}_") for name in entry.queries()) == 1
