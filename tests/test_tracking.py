"""Tracking in chunks against a plain frame-by-frame tracker."""

import json
import random

import pytest

from fieldspark.operators import tracking as K

DETECTION = "video_id string, frame_index long, detection_id string, class_id string, confidence double, x1 double, y1 double, x2 double, y2 double, timestamp_ms long"


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    shared = max(0.0, w) * max(0.0, h)
    return shared / max(1e-9, (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared)


def sequential(detections, motions):
    """Detection id to (track id, status), one frame after the other, pair by pair."""
    out = {}
    for video in {d[0] for d in detections}:
        frames = {}
        for d in detections:
            if d[0] == video:
                frames.setdefault(d[1], []).append(d)
        moves = {f: m for v, f, m in motions if v == video}
        tracks, count = [], {}
        for frame in sorted(frames.keys() | moves.keys()):
            m = moves.get(frame, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0])
            for t in tracks:
                (x1, y1), (x2, y2) = ((m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]) for x, y in (t["box"][:2], t["box"][2:]))
                t["box"] = [min(1.0, max(0.0, v)) for v in (min(x1, x2), min(y1, y2), max(x1, x2), max(y1, y2))]
            dets = sorted(frames.get(frame, []), key=lambda d: d[2])
            pairs = []
            for i, d in enumerate(dets):
                for j, t in enumerate(tracks):
                    age = frame - t["last"]
                    if age <= 2 and t["class"] == d[3]:
                        a, b = d[5:9], t["box"]
                        apart = (((a[0] + a[2] - b[0] - b[2]) / 2) ** 2 + ((a[1] + a[3] - b[1] - b[3]) / 2) ** 2) ** 0.5
                        o = overlap(a, b)
                        score = round(0.65 * o + 0.35 * max(0.0, 1 - apart / 0.22) - 0.025 * max(0, age - 1), 12)
                        if (o >= 0.015 or apart <= 0.16) and score >= 0.2:
                            pairs.append((score, i, j, age))
            used, taken = {}, set()
            for _, i, j, age in sorted(pairs, reverse=True):
                if i not in used and j not in taken:
                    used[i] = (j, age)
                    taken.add(j)
            for i, d in enumerate(dets):
                if i in used:
                    t, status = tracks[used[i][0]], "continued" if used[i][1] == 1 else "reacquired"
                else:
                    n = count[d[3]] = count.get(d[3], 0) + 1
                    t, status = {"class": d[3], "id": f"{video}-{K.PREFIXES.get(d[3], d[3])}-{n:03d}"}, "new"
                    tracks.append(t)
                t |= {"box": list(d[5:9]), "last": frame}
                out[d[2]] = (t["id"], status)
    return out


def video(name, frames, rng, step):
    """Detections on nearly every frame: steady objects, crossing ones, copies with equal boxes; coordinates on a coarse grid, so scores tie."""
    rows, motions = [], []
    for f in range(frames):
        if rng.random() < 0.9:
            motions.append((name, f, [1.0, 0.0, rng.choice([0.0, 0.0, step]), 0.0, 1.0, 0.0]))
        boxes = [("tree", 0.25, 0.25), ("tree", 0.25 + step * (f % 9), 0.25), ("shrub", 0.75 - step * (f % 7), 0.5)]
        boxes += [("tree", rng.randrange(12) / 16, rng.randrange(8) / 16) for _ in range(rng.randrange(3))]
        if f % 3 != 1:
            boxes.append(boxes[0])
        if f % 41 > 37:
            boxes = []
        for k, (kind, x, y) in enumerate(boxes):
            rows.append((name, f, f"{name}{(f * 7919 + k * 31) % 10007:05d}-{k}", kind, 0.5, x, y, x + 0.125, y + 0.25, f * 40))
    return rows, motions


@pytest.mark.parametrize("chunk, warm_up", [(2048, 24), (16, 4), (5, 0), (3, 7)])
def test_chunks_equal_the_sequential_tracker(spark, chunk, warm_up):
    rng = random.Random(chunk)
    rows, motions = [], []
    for name, frames in (("a", 140), ("b", 47), ("c", 1)):
        d, m = video(name, frames, rng, 1 / 32)
        rows, motions = rows + d, motions + m
    rng.shuffle(rows)
    tracked = K.track_detections(spark.createDataFrame(rows, DETECTION), spark.createDataFrame(motions, "video_id string, frame_index long, m array<double>"), chunk=chunk, warm_up=warm_up)
    assert {r["detection_id"]: (r["track_id"], r["tracking_status"]) for r in tracked.collect()} == sequential(rows, motions)


def test_only_differing_chunks_are_tracked_again():
    calm = [(f, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], [{"detection_id": f"d{f:03d}", "class_id": "tree", "box": [0.2, 0.2, 0.3, 0.4]}]) for f in range(60)]
    state = {"open": [], "counts": {}}
    for chunk in range(3):
        rows = [r for r in calm if chunk * 20 - 4 <= r[0] < chunk * 20 + 20]
        out = K._walk_chunk(rows, chunk, chunk * 20, None, 0, (1.0, 1.0))
        valid, alive, before, known = K._settle(state, json.loads(out[-1][-1]))
        assert valid and len(out) == 21 and (before, list(known.values())) == (({}, []) if chunk == 0 else ({"tree": 1}, [1]))


def test_no_detections(spark):
    none = spark.createDataFrame([], DETECTION)
    assert K.track_detections(none, spark.createDataFrame([], "video_id string, frame_index long, m array<double>")).collect() == []


def test_duplicates_of_many_and_crowded_frames(spark, monkeypatch):
    """Frames over several Arrow batches, one larger than a block of pairs; equal, missing and NaN confidences, null keys and coordinates."""
    monkeypatch.setattr(K, "PAIRS_AT_ONCE", 50)
    draw = random.Random(7)
    rows = []
    for n in range(900):
        frame = 0 if n < 300 else draw.choice([None, *range(1, 40)])
        x, y = draw.random() * 0.8, draw.random() * 0.8
        sure = draw.choice([0.5, 0.9, None, float("nan"), draw.random()])
        rows.append((draw.choice(["v", "w"]) if n >= 300 else "v", frame, f"d{n:03d}", "tree", sure, None if n % 50 == 7 else x, y, x + 0.2, y + 0.15, n))
    want = set()
    for at in {r[:2] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[:2] == at), key=lambda r: (-r[4] if r[4] is not None and r[4] == r[4] else 1, r[2])):
            if r[5] is None or not any(abs((r[5] + r[7] - k[5] - k[7]) / 2) < 0.026 and overlap(r[5:9], k[5:9]) > 0.04 for k in kept if k[5] is not None):
                kept.append(r)
        want |= {r[2] for r in kept}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        kept = K.suppress_duplicates(spark.createDataFrame(rows, DETECTION).repartition(3), key=("video_id", "frame_index"))
        assert "FlatMapGroupsInPandas" not in kept._jdf.queryExecution().toString()  # a Python call for every frame
        got = [r["detection_id"] for r in kept.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(set(got)) and set(got) == want and len(want) < 900
    assert K.suppress_duplicates(spark.createDataFrame([], DETECTION), key=("video_id", "frame_index")).count() == 0


def test_few_boxes_are_rated_as_by_arrays():
    draw = random.Random(3)
    place = lambda: [x := draw.random() * 0.5, y := draw.random() * 0.5, x + draw.choice([0.1, 0.3]), y + draw.choice([0.1, 0.3])]
    rated = 0
    for _ in range(2000):
        alive = {str(k): {"class_id": draw.choice("ab"), "box": place(), "last": 10 - draw.choice([1, 2])} for k in range(draw.randrange(6))}
        dets = [{"detection_id": str(k), "class_id": draw.choice("ab"), "box": place()} for k in range(draw.randrange(6))]
        if alive and dets and draw.random() < 0.3:
            dets[0]["box"] = list(next(iter(alive.values()))["box"])
        size = draw.choice([(1.0, 1.0), (640, 480)])
        motion = [draw.choice([1.0, draw.uniform(-2, 2)]), 0.0, draw.uniform(-0.1, 0.1) * size[0], 0.0, draw.choice([1.0, 0.7]), draw.uniform(-0.1, 0.1)]
        moved, _, score, allowed = K._rate(alive, 10, motion, dets, size)
        few, pairs = K._rate_few(alive, 10, motion, dets, size)
        rows, columns = allowed.nonzero()
        assert few == moved.tolist() and sorted(pairs) == sorted((score[i, j], i, j) for i, j in zip(rows, columns))
        order = K.np.arange(len(alive))
        assert K._assign_few(pairs) == K.assign(score, allowed, order)
        names, taken = list(alive), frozenset(n for n in alive if n != "1")
        by_array, one_by_one = K.Watch(taken), K.Watch(taken)
        by_array.look(names, score, allowed)
        one_by_one.look_few(names, pairs)
        assert by_array.tied == one_by_one.tied
        rated += len(pairs)
    assert rated > 500
    assert K._rate_few({}, 1, [1.0, 0.1, 0.0, 0.0, 1.0, 0.0], [], (1.0, 1.0)) is None and K._rate_few({}, 1, [1.0, 0.0, None, 0.0, 1.0, 0.0], [], (1.0, 1.0)) is None


def test_chunks_of_many_videos_in_one_task(spark):
    """Many short videos share tasks, over batches of a few frames and more links than a task collects."""
    draw = random.Random(5)
    rows = []
    for n in range(1500):
        x, y = draw.random() * 0.7, draw.random() * 0.7
        rows.append((f"v{n % 60}", n // 180, f"d{n:04d}", draw.choice(["tree", "shrub"]), 0.5, x, y, x + 0.2, y + 0.2, n))
    moves = [(f"v{v}", f, [1.0, 0.0, 0.01, 0.0, 1.0, 0.0]) for v in range(60) for f in range(12)]
    before = {c: spark.conf.get(c) for c in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        tracked = K.track_detections(spark.createDataFrame(rows, DETECTION), spark.createDataFrame(moves, "video_id string, frame_index long, m array<double>"), chunk=4, warm_up=2)
        got = {r["detection_id"]: (r["track_id"], r["tracking_status"]) for r in tracked.collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert got == sequential(rows, moves)
