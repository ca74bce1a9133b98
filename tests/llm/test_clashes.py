"""Extra columns named as the stages name theirs, and repeated benchmark rows."""

import random

from fieldspark.llm import op02_bbit_minhash as op2
from fieldspark.llm import op03_divergence as op3
from fieldspark.llm import op04_sparse_suffixes as op4
from fieldspark.llm import op10_spaced_seeds as op10

from .helpers import corpus, sentence, table

NAMES = ["_key", "_row", "_maybe", "_spans", "_id", "_lang", "_ref", "id", "key", "node", "set", "c0", "c1", "band", "Row"]


def test_stages_keep_columns_of_any_name(spark):
    rows = [(i, t) for i, t in corpus() if i is not None]
    docs = table(spark, rows).drop("id", "row", "key")
    for name in NAMES[:-1]:
        docs = docs.withColumn(name, docs["doc_id"] + len(name))
    plain = table(spark, rows).drop("id", "row", "key")
    for stage in (op2.keep_one, op4.cut_repeats, op3.keep_good, lambda d: op10.drop_contaminated(d, d.select(d["doc_id"].alias("item_id"), "text").limit(2))):
        got, want = stage(docs), stage(plain)
        assert got.columns == docs.columns
        assert sorted(map(repr, got.select(plain.columns).collect())) == sorted(map(repr, want.collect()))
        assert all(r["_key"] == r["doc_id"] + 4 and r["c1"] == r["doc_id"] + 2 for r in got.collect())


def test_repeated_benchmark_rows(spark, monkeypatch):
    monkeypatch.setattr(op10, "BLOCK", 60)
    rng = random.Random(1)
    item = sentence(rng, 40)
    benchmark = spark.createDataFrame([(7, item)] * 5 + [(8, sentence(rng, 30)), (None, item), (None, item), (9, None)], "item_id long, text string")
    docs = table(spark, [(1, "before " + item + " after"), (2, "nothing of it here at all"), (3, None)])
    assert [r["doc_id"] for r in op10.drop_contaminated(docs, benchmark).orderBy("doc_id").collect()] == [2, 3]
    assert {(r["doc_id"], r["item_id"]) for r in op10.contaminated(docs, benchmark).collect()} >= {(1, 7)}
