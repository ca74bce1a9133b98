import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import rows

SF = os.environ.get("FIELDSPARK_SF", "/root/testdata/sf0.001")
FEW = ["a1_confusion_counts", "a18_gram", "a26_reason_keys", "d1_suppress_duplicates", "k3_resume_write", "m4_score", "x4_stream_interval_alerts", "g2_dilate", "w2_frame_split", "j4_asof_join", "j6_overlapping_intervals", "j16_upsert_runs", "a22_threshold_candidates", "a13_track_summary", "k4_reuse_results", "x1_stream_score", "g4_grade", "p1_polygon", "g7_graded_corridors", "t4_evidence_rules", "g13_region_table"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("FIELDSPARK_ALL") else FEW


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


def test_entry(spark):
    df = entry.entry(spark)
    assert "iou" in df.columns and df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns) and got == rows(columns, cursor.fetchall())


@pytest.mark.parametrize("name", ["j2_mask_overlap", "j4_asof_join", "j12_region_at_point", "j15_candidate_matches"])
def test_no_nested_loops(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
