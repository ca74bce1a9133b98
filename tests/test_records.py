"""Constraint sets, reason keys, region reasons."""

import pytest

from fieldspark.functions import records as C
from fieldspark.functions import rules as P
from fieldspark.operators import terrain as T
from fieldspark.session import run_dir

GOOD = {"id": "path-1", "points": [[0.0, 0.1]] * 3, "certainty": "certain", "origin": "manual", "note": "", "uncertainty_reason": "", "tracking_id": None, "carried_from_frame": None, "edit": "new"}
POLYGON = "id string, points array<array<double>>, certainty string, origin string, note string, uncertainty_reason string, tracking_id string, carried_from_frame long, edit string"


def test_records_are_counted_in_the_pass_that_writes_them(spark):
    wrong = [{}, {"id": "a b"}, {"id": "ok\n"}, {"id": "x" * 81}, {"points": [[0.0, 0.1]] * 2}, {"note": None}, {"note": "n" * 501, "edit": "moved"}, {"tracking_id": ""}, {"tracking_id": "t_1"}, {"carried_from_frame": -1}, {"points": None}]
    rows = [tuple((GOOD | w).values()) for w in wrong]
    path = run_dir(spark, "checked")
    counts = C.write_checked(spark.createDataFrame(rows, POLYGON), "polygon", path)
    assert counts == {"records": 11, "quarantined": 9, "id_pattern": 3, "point_count": 2, "certainty": 0, "origin": 0, "note_length": 2, "reason_length": 0, "tracking_pattern": 1, "carried_from": 1, "edit": 1}
    table = spark.read.parquet(path)
    assert table.where("valid = 'true'").count() == 2 and {tuple(r["violations"]) for r in table.where("valid = 'false' AND edit = 'moved'").collect()} == {("note_length", "edit")}
    none = C.write_checked(spark.createDataFrame([], POLYGON), "polygon", run_dir(spark, "checked"))
    assert set(none.values()) == {0} and none.keys() == counts.keys()


def test_mission_rules(spark):
    place = "struct<lat:double,lng:double>"
    schema = f"name string, notes string, start {place}, end {place}, route array<{place}>, pauses array<struct<start_seconds:double,end_seconds:double>>"
    rows = [("abc", "", None, None, [], None), ("ab", "", (91.0, 0.0), (0.0, -181.0), [(0.0, 0.0), (0.0, 200.0)], [(5.0, 4.0)]), ("abc", "", (90.0, 180.0), None, None, [(1.0, 1.0), (0.0, None)])]
    counts = C.write_checked(spark.createDataFrame(rows, schema), "mission", run_dir(spark, "checked"))
    assert counts == {"records": 3, "quarantined": 2, "name_length": 1, "notes_length": 0, "start_range": 1, "end_range": 1, "route_range": 1, "pause_order": 2}


@pytest.mark.parametrize("kind", sorted(C.RULES))
def test_every_type_has_rules(kind):
    assert all(code.isidentifier() for code in C.RULES[kind]()) and len(C.RULES[kind]()) >= 3


def test_keys_of_reasons_never_meet(spark):
    labels = spark.createDataFrame([("a!b",), ("a b",), ("a b 2",), ("A-B",), ("a b",), (None,), ("x" * 60,), ("x" * 61,)], "label string")
    keys = {r["label"]: r["key"] for r in P.reason_keys(labels).collect()}
    assert len(set(keys.values())) == len(keys) == 6
    assert keys["A-B"] == "custom_a_b" and keys["a b"] == "custom_a_b-2" and keys["a!b"] == "custom_a_b-3" and keys["a b 2"] == "custom_a_b_2"
    given = spark.createDataFrame(list(keys.items()), "label string, key string")
    more = labels.unionByName(spark.createDataFrame([(" a,b",), ("A",)], "label string"))
    later = {r["label"]: r["key"] for r in P.reason_keys(more, given=given).collect()}
    assert {k: later[k] for k in keys} == keys and later[" a,b"] == "custom_a_b-4" and later["A"] == "custom_a" and len(later) == 8


def test_regions_are_described(spark):
    regions = spark.createDataFrame([(1, 1, 1), (1, 3, 2), (2, 0, 1)], "frame_index long, value int, rank int")
    sure = spark.createDataFrame([(1, 0.71449)], "frame_index long, overall_confidence double")
    got = {r["region_id"]: r for r in T.describe_regions(regions, sure, ["frame_index"]).collect()}
    assert got.keys() == {"likely_traversable-01", "not_traversable-02", "unknown-01"}
    assert got["not_traversable-02"]["confidence"] == 0.714 and got["unknown-01"]["confidence"] is None and len(got["likely_traversable-01"]["reasons"]) == 3


def test_two_distinct_points_are_told_without_comparing_all(spark):
    rule = C.trajectory_rules()["distinct_points"]
    assert "array_distinct" not in str(rule)  # compares arrays one with all others
    a, near, far, null = [0.5, 0.25], [0.500000001, 0.25], [0.5, 0.75], [None, 0.25]
    lists = [([], False), ([a], False), ([a] * 400, False), ([a, near] * 9, False), ([a] * 399 + [far], True), ([a, null], True), ([null] * 3, False), ([None, a], True), ([None] * 2, False), (None, None)]
    rows = spark.createDataFrame([(k, points) for k, (points, _) in enumerate(lists)], "k int, points array<array<double>>").select("k", rule.alias("ok"))
    assert {r["k"]: r["ok"] for r in rows.collect()} == {k: ok for k, (_, ok) in enumerate(lists)}
    xy = spark.createDataFrame([([(0.5, 0.25)] * 2,), ([(0.5, 0.25), (0.500000001, 0.25)],), ([(0.5, 0.25), (0.5, 0.26)],)], "points array<struct<x:double,y:double>>")
    assert [r["ok"] for r in xy.select(P.valid_trajectory(xy["points"]).alias("ok")).collect()] == [False, False, True]


def test_writing_records_puts_the_setting_of_writers_back(spark):
    before = spark.conf.get(C.WRITERS_CONF)
    C.write_checked(spark.createDataFrame([tuple(GOOD.values())], POLYGON), "polygon", path := run_dir(spark, "checked"))
    assert spark.conf.get(C.WRITERS_CONF) == before and spark.read.parquet(path).count() == 1
