"""Queries on validation rules and small expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions import records as R
from fieldspark.functions import rules as P
from fieldspark.functions.records import write_checked
from fieldspark.plans import bindings as B
from fieldspark.plans.bindings import sql, table
from fieldspark.plans.catalog import query
from fieldspark.session import run_dir


@query(
    "p1_validate",
    """SELECT event_id, concat_ws(',', CASE WHEN NOT value BETWEEN 1 AND 300 THEN 'value_range' END, CASE WHEN event_type NOT IN ('click', 'view', 'signup', 'error') THEN 'unknown_type' END,
      CASE WHEN NOT length(props) BETWEEN 1 AND 8 THEN 'props_length' END) AS violations FROM events
    WHERE NOT value BETWEEN 1 AND 300 OR event_type NOT IN ('click', 'view', 'signup', 'error') OR NOT length(props) BETWEEN 1 AND 8""",
)
def p1(spark, sf):
    rules = {
        "value_range": P.in_range(F.col("value"), 1, 300),
        "unknown_type": P.one_of(F.col("event_type"), ("click", "view", "signup", "error")),
        "props_length": P.length_between(F.col("props"), 1, 8),
    }
    _, bad = P.validate(table(spark, sf, "events"), rules)
    return bad.select("event_id", F.array_join("violations", ",").alias("violations"))


def checked(spark, records, kind):
    """Counts of one record type, as rows."""
    counts = write_checked(records, kind, run_dir(spark, f"checked-{kind}"))
    return spark.createDataFrame([(rule, int(n)) for rule, n in counts.items()], "rule string, broken long")


def counts_sql(records: str, **rules: str) -> str:
    """The same counts; a rule that gives null counts as broken."""
    every = {"records": "true", "quarantined": " OR ".join(f"NOT coalesce({ok}, false)" for ok in rules.values())} | {code: f"NOT coalesce({ok}, false)" for code, ok in rules.items()}
    return f"WITH r AS ({records})\n" + "\nUNION ALL ".join(f"SELECT '{name}' AS rule, count(*) FILTER ({broken}) AS broken FROM r" for name, broken in every.items())


def _points(n: str, step: str) -> str:
    return f"transform(sequence(1, greatest(1, cast({n} AS int))), k -> array(k * {step}, 1 - k * {step}))"


@query(
    "p1_mission",
    counts_sql(
        "SELECT source || '-' || lang AS name, text AS notes, n_chars / 50.0::DOUBLE - 40 AS lat, n_chars / 10.0::DOUBLE - 100 AS lng, doc_id % 5 <> 0 AS placed, n_chars % 700 AS p0, n_chars % 1100 AS p1, doc_id % 3 = 0 AS paused FROM documents",
        name_length="length(name) BETWEEN 3 AND 120", notes_length="length(notes) BETWEEN 0 AND 5000", start_range="NOT placed OR (lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180)",
        end_range="NOT placed OR (-lat BETWEEN -90 AND 90 AND lng / 2 BETWEEN -180 AND 180)", route_range="NOT placed OR (lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND lng / 2 BETWEEN -180 AND 180)",
        pause_order="NOT paused OR p1 >= p0",
    ),
)
def p1_mission(spark, sf):
    d, chars = table(spark, sf, "documents"), F.col("n_chars")
    lat, lng = chars / F.lit(50.0) - 40, chars / F.lit(10.0) - 100
    place = lambda a, b: F.struct(a.alias("lat"), b.alias("lng"))
    placed, paused = F.col("doc_id") % 5 != 0, F.col("doc_id") % 3 == 0
    pause = F.struct((chars % 700).alias("start_seconds"), (chars % 1100).alias("end_seconds"))
    records = d.select(
        F.concat_ws("-", "source", "lang").alias("name"), F.col("text").alias("notes"), F.when(placed, place(lat, lng)).alias("start"), F.when(placed, place(-lat, lng / 2)).alias("end"),
        F.when(placed, F.array(place(lat, lng), place(-lat, lng / 2))).alias("route"), F.when(paused, F.array(pause)).alias("pauses"),
    )
    return checked(spark, records, "mission")


@query(
    "p1_annotation",
    counts_sql(
        "SELECT d.*, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)",
        timestamp="n_chars - 60 >= 0", hash_pattern="doc_id % 4 = 0 OR (length(left(md5(text), 8 + doc_id % 25)) BETWEEN 12 AND 128 AND doc_id % 7 <> 0)", polygon_count="n_chars % 150 BETWEEN 0 AND 120", roi_count="doc_id % 22 BETWEEN 0 AND 20",
        status="quality IS NOT NULL", annotator_length="length(source) BETWEEN 1 AND 80", notes_length="length(text) BETWEEN 0 AND 1000", frame_width="doc_id % 2 = 0 OR n_chars * 4 BETWEEN 1 AND 16384",
        frame_height="doc_id % 3 = 0 OR n_chars * 2 BETWEEN 1 AND 16384", label_mode="lang IN ('en', 'de')",
    ),
)
def p1_annotation(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    i, chars = F.col("doc_id"), F.col("n_chars")
    cut = F.md5("text").substr(F.lit(1), (8 + i % 25).cast("int"))
    hashed = F.when(i % 7 == 0, F.concat(F.lit("x"), cut.substr(F.lit(2), F.length(cut)))).otherwise(cut)
    records = d.select(
        (chars - 60).alias("timestamp_ms"), F.when(i % 4 != 0, hashed).alias("source_frame_hash"), (chars % 150).alias("n_polygons"), (i % 22).alias("n_roi"),
        F.when(F.col("quality") == 1, "confirmed").when(F.col("quality") == 0, "skipped").alias("status"), F.col("source").alias("annotator"), F.col("text").alias("notes"),
        F.when(i % 2 != 0, chars * 4).alias("frame_width"), F.when(i % 3 != 0, chars * 2).alias("frame_height"), F.when(F.col("lang").isin("en", "de"), "linear").otherwise(F.col("lang")).alias("label_mode"),
    )
    return checked(spark, records, "annotation")


@query(
    "p1_polygon",
    counts_sql(
        "SELECT *, replace(role, 'u', ' ') || '-' || conv_id AS id FROM conversations",
        id_pattern="length(id) BETWEEN 1 AND 80 AND regexp_full_match(id, '[a-zA-Z0-9_-]+')", point_count="length(text) % 600 + 1 BETWEEN 3 AND 500", certainty="turn % 4 < 3", origin="role = 'user'", note_length="length(text) BETWEEN 0 AND 500",
        reason_length="length(text) // 2 BETWEEN 0 AND 120", tracking_pattern="conv_id % 3 = 0 OR conv_id % 5 <> 0", carried_from="conv_id % 2 = 0 OR turn >= 2", edit="turn % 6 < 4",
    ),
)
def p1_polygon(spark, sf):
    c, turn, size = table(spark, sf, "conversations"), F.col("turn"), F.length("text")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    records = c.select(
        F.concat_ws("-", F.translate("role", "u", " "), F.col("conv_id").cast("string")).alias("id"), F.expr(_points("length(text) % 600 + 1", "0.001D")).alias("points"), pick((*R.CERTAINTIES, "maybe"), turn % 4).alias("certainty"),
        F.when(F.col("role") == "user", "manual").otherwise(F.col("role")).alias("origin"), F.col("text").alias("note"), F.repeat(F.lit("r"), F.floor(size / 2).cast("int")).alias("uncertainty_reason"),
        F.when(F.col("conv_id") % 3 != 0, F.when(F.col("conv_id") % 5 == 0, "t 1").otherwise("t-1")).alias("tracking_id"), F.when(F.col("conv_id") % 2 != 0, turn - 2).alias("carried_from_frame"), pick((*R.EDITS, "gone", ""), turn % 6).alias("edit"),
    )
    return checked(spark, records, "polygon")


@query(
    "p1_video",
    counts_sql("SELECT * FROM pages", direction="page_id % 3 < 2", orientation="length(url) % 4 < 3", terrain_length="page_id % 6 = 0 OR length(url) * 3 BETWEEN 1 AND 120"),
)
def p1_video(spark, sf):
    p, i, size = table(spark, sf, "pages"), F.col("page_id"), F.length("url")
    records = p.select(
        F.element_at(F.array(*[F.lit(v) for v in (*R.DIRECTIONS, "A")]), (i % 3 + 1).cast("int")).alias("direction"), F.when(size % 4 < 3, "PORTRAIT").alias("orientation"),
        F.when(i % 6 != 0, F.repeat(F.lit("t"), (size * 3).cast("int"))).alias("terrain_category"),
    )
    return checked(spark, records, "video")


@query(
    "p1_roi_profile",
    counts_sql(
        "SELECT vec_id % 7 <> 0 AS has_top, vec_id % 5 <> 0 AS has_bottom, embedding[1]::DOUBLE + 0.4 AS t, embedding[2]::DOUBLE + 0.5 AS b, label FROM embeddings", top_band="NOT has_top OR (t > 0 AND t < 1)", bottom_band="NOT has_bottom OR (b > 0 AND b < 1)",
        room_between="CASE WHEN has_top THEN t ELSE 0 END + CASE WHEN has_bottom THEN b ELSE 0 END < 1", note_length="label * 150 BETWEEN 0 AND 1000",
    ),
)
def p1_roi_profile(spark, sf):
    e = table(spark, sf, "embeddings")
    top, bottom = F.col("embedding")[0].cast("double") + 0.4, F.col("embedding")[1].cast("double") + 0.5
    records = e.select(F.when(F.col("vec_id") % 7 != 0, top).alias("top_ignore_fraction"), F.when(F.col("vec_id") % 5 != 0, bottom).alias("bottom_ignore_fraction"), F.repeat(F.lit("n"), (F.col("label") * 150).cast("int")).alias("note"))
    return checked(spark, records, "roi_profile")


@query(
    "p1_interval",
    counts_sql(
        "SELECT event_id, event_id * 10 - 300 AS s, event_id * 10 - 300 + CAST(floor(value * 20) AS BIGINT) - 40 AS e, props, event_type FROM events", start="s >= 0", order="e > s", too_short="e - s >= 200",
        note_length="length(props) * 60 BETWEEN 0 AND 500", annotator_length="event_type <> 'view'",
    ),
)
def p1_interval(spark, sf):
    start = F.col("event_id") * 10 - 300
    note = F.repeat(F.lit("n"), (F.length("props") * 60).cast("int"))
    records = table(spark, sf, "events").select(
        start.alias("start_ms"), (start + F.floor(F.col("value") * 20).cast("long") - 40).alias("end_ms"), note.alias("note"), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("annotator")
    )
    return checked(spark, records, "interval")


@query(
    "p1_trajectory",
    counts_sql(
        "SELECT *, event_id % 450 + 1 AS n, event_id % 5 = 0 AS still FROM events", timestamp="event_id >= 50", point_count="n BETWEEN 2 AND 400", normalised="still OR n * 0.0024::DOUBLE <= 1", distinct_points="NOT still AND n >= 2",
        corridor="event_type IN ('click', 'view') OR event_type IS NULL", origin="user_id % 4 < 3", note_length="length(props) * 130 BETWEEN 0 AND 1000", annotator_length="length(event_type) BETWEEN 1 AND 80",
    ),
)
def p1_trajectory(spark, sf):
    e, i = table(spark, sf, "events"), F.col("event_id")
    moving, still = F.expr(_points("event_id % 450 + 1", "0.0024D")), F.expr("transform(sequence(1, cast(event_id % 450 + 1 AS int)), k -> array(0.5D, 0.25D))")
    kind = F.when(F.col("event_type") == "click", "mitte").when(F.col("event_type") == "view", "links").otherwise(F.col("event_type"))
    records = e.select(
        (i - 50).alias("timestamp_ms"), F.when(i % 5 == 0, still).otherwise(moving).alias("points"), kind.alias("corridor"), F.element_at(F.array(*[F.lit(v) for v in (*R.TRAJECTORY_ORIGINS, "machine")]), (F.col("user_id") % 4 + 1).cast("int")).alias("origin"),
        F.repeat(F.lit("n"), (F.length("props") * 130).cast("int")).alias("note"), F.col("event_type").alias("annotator"),
    )
    return checked(spark, records, "trajectory")


@query(
    "p2_valid_rle",
    """SELECT event_id, (event_id % 6) <= 4 AND event_id % 5 > 0 AND (event_id % 5 + event_id % 9 + 1) = (event_id % 4 + 2) * 2 AS valid FROM events""",
)
def p2(spark, sf):
    e = F.col("event_id")
    rle = F.array(e % 6, e % 5, F.lit(1).cast("long"), e % 9 + 1)
    return table(spark, sf, "events").select("event_id", P.valid_rle(rle, e % 4 + 2, F.lit(2)).alias("valid"))


POLY = """SELECT event_id, ['tree', 'traversable', 'boat'][event_id % 3 + 1] AS c, value / 250 AS x, (event_id % 100) / 99.0::DOUBLE AS y, (event_id % 2) / 2.0::DOUBLE AS z FROM events"""


@query(
    "p3_valid_polygon",
    f"""SELECT event_id, c <> 'boat' AND x <= 1 AND len(list_distinct([[round_even(x, 8), round_even(y, 8)], [round_even(x, 8), z], [z, z], [0, 0]])) >= 3 AS valid FROM ({POLY})""",
)
def p3(spark, sf):
    e = F.col("event_id")
    x, y, z = F.col("value") / 250, (e % 100) / F.lit(99.0), (e % 2) / F.lit(2.0)
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    name = F.element_at(F.array(F.lit("tree"), F.lit("traversable"), F.lit("boat")), (e % 3 + 1).cast("int"))
    polygon = F.struct(name.alias("class_id"), F.array(point(x, y), point(x, z), point(z, z), point(F.lit(0.0), F.lit(0.0))).alias("points"))
    return table(spark, sf, "events").select("event_id", P.valid_polygon(polygon).alias("valid"))


@query("p4_layer_consistency", "SELECT event_id, event_id % 4 <> 1 AND event_id % 5 <> 2 AS valid, NOT (0.3 + (event_id % 8) / 10.0 >= 1) AS room FROM events")
def p4(spark, sf):
    e = F.col("event_id")
    one = lambda name: F.array(F.struct(name.alias("class_id")))
    polygons = one(F.when(e % 4 == 1, "roi_ignore").otherwise("tree"))
    roi = one(F.when(e % 5 == 2, "shrub").otherwise("roi_interest"))
    bottom = F.when(e % 8 > 0, (e % 8) / F.lit(10.0))
    return table(spark, sf, "events").select(
        "event_id", P.layer_consistency(polygons, roi).alias("valid"), P.bands_leave_room(F.lit(0.3), bottom).alias("room")
    )


@query(
    "p5_valid_interval",
    "SELECT event_id, floor(value * 10) > 0 AND floor(value * 10) >= 200 AS valid, floor(value) >= event_id % 50 AS pause_ok FROM events",
)
def p5(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id",
        P.valid_interval(e, e + F.floor(F.col("value") * 10)).alias("valid"),
        P.valid_pause(e % 50, F.floor("value")).alias("pause_ok"),
    )


@query("p6_valid_trajectory", "SELECT event_id, value / 250 <= 1 AND NOT (value / 250 = 0.5 AND event_id % 2 = 1) AND event_id % 3 > 0 AS valid FROM events")
def p6(spark, sf):
    e = F.col("event_id")
    x = F.col("value") / 250
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    other = F.when(e % 2 == 1, F.lit(0.5)).otherwise(F.lit(0.25))
    both = F.array(point(x, F.lit(0.5)), point(F.when(e % 3 == 0, x).otherwise(F.lit(0.5)), F.when(e % 3 == 0, F.lit(0.5)).otherwise(other)))
    return table(spark, sf, "events").select("event_id", P.valid_trajectory(both).alias("valid"))


@query("p7_confirmed_path_frames", sql("SELECT mission_id, video_id, frame_index FROM ann WHERE status = 'confirmed' AND n_poly > 0 AND class_id = 'traversable'", "ann"))
def p7(spark, sf):
    return P.confirmed_path_frames(B.annotations(spark, sf)).select("mission_id", "video_id", "frame_index")


@query("p8_status_rules", sql("SELECT frame_index, status, NOT ((status = 'confirmed' AND n_poly = 0) OR (status = 'skipped' AND n_poly > 0)) AS valid FROM ann", "ann"))
def p8(spark, sf):
    ok = P.status_rules(F.col("status"), F.col("n_poly") > 0)
    return B.annotations(spark, sf).select("frame_index", "status", ok.alias("valid"))


@query(
    "p9_provenance_check",
    sql(
        """SELECT event_id, violations FROM (SELECT event_id, concat_ws(',', CASE WHEN NOT frame_index < total_frames THEN 'frame' END, CASE WHEN abs(off) > greatest(2, round_even(1000 / fps, 0)) THEN 'timestamp' END,
          CASE WHEN event_id % 3 = 2 THEN 'hash' END) AS violations FROM (
            SELECT f.event_id, f.frame_index, v.fps, 60 AS total_frames, f.event_id % 211 AS off FROM frames f JOIN videos v USING (video_id))) WHERE violations <> ''""",
        "videos",
    ),
)
def p9(spark, sf):
    videos = B.videos(spark, sf).withColumn("total_frames", F.lit(60).cast("long"))
    e = F.col("event_id")
    stamped = B.frames(spark, sf).join(videos.select("video_id", "fps", "sha256"), "video_id")
    good = P.frame_hash(F.col("sha256"), F.col("frame_index"), F.col("fps"))
    records = stamped.select(
        "event_id",
        "video_id",
        "frame_index",
        (P.frame_timestamp(F.col("frame_index"), F.col("fps")) + e % 211).alias("timestamp_ms"),
        F.when(e % 3 == 0, F.lit(None)).when(e % 3 == 1, good).otherwise(F.sha2(e.cast("string"), 256)).alias("source_frame_hash"),
    )
    _, bad = P.provenance_check(records, videos, ["video_id"])
    return bad.select("event_id", F.array_join("violations", ",").alias("violations"))


@query(
    "p9_frame_hash",
    sql(
        """SELECT f.event_id, CAST(round_even(frame_index / fps * 1000, 0) AS BIGINT) AS timestamp_ms,
        sha256(concat_ws(':', v.sha256, CAST(frame_index AS VARCHAR), CAST(CAST(round_even(frame_index / fps * 1000, 0) AS BIGINT) AS VARCHAR))) AS frame_hash FROM frames f JOIN videos v USING (video_id)""",
        "videos",
    ),
)
def p9_hash(spark, sf):
    videos = B.videos(spark, sf).select("video_id", "fps", "sha256")
    return B.frames(spark, sf).join(videos, "video_id").select(
        "event_id",
        P.frame_timestamp(F.col("frame_index"), F.col("fps")).alias("timestamp_ms"),
        P.frame_hash(F.col("sha256"), F.col("frame_index"), F.col("fps")).alias("frame_hash"),
    )


@query("p10_integrity_check", "SELECT doc_id, doc_id % 4 <> 1 AS valid, sha256(text) AS actual FROM documents")
def p10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    files = docs.select("doc_id", F.encode("text", "utf-8").alias("content"))
    expected = F.when(F.col("doc_id") % 4 == 1, F.lit("0" * 64)).otherwise(F.sha2("text", 256))
    return P.integrity_check(files, docs.select("doc_id", expected.alias("sha256")), ["doc_id"]).select("doc_id", "valid", "actual")


@query(
    "p11_apply_patch",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'PATCHED' WHEN 2 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
      CASE WHEN c_custkey % 4 = 1 THEN -1 WHEN c_custkey % 4 = 2 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer""",
)
def p11(spark, sf):
    base = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    k = F.col("c_custkey") % 4
    fields = F.when(k == 0, F.array(F.lit("c_mktsegment"))).when(k == 1, F.array(F.lit("c_acctbal"))).otherwise(F.array(F.lit("c_mktsegment"), F.lit("c_acctbal")))
    patch = base.where(k < 3).select(
        "c_custkey", F.when(k == 0, "PATCHED").alias("c_mktsegment"), F.when(k != 2, F.lit(-1.0)).alias("c_acctbal"), fields.alias("set_fields")
    )
    return P.apply_patch(base, patch, ["c_custkey"], ["c_mktsegment", "c_acctbal"])


@query("p12_normalise_text", r"SELECT doc_id, md5(nullif(trim(regexp_replace(text, '[\s\v]+', ' ', 'g')), '')) AS digest FROM documents")
def p12(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(P.normalise_text(F.col("text"))).alias("digest"))


@query(
    "p13_search_history",
    sql("""SELECT mission_id, video_id, frame_index FROM ann WHERE status = 'confirmed' AND (lower('Walk-' || video_id) LIKE '%12%' OR lower(annotator) LIKE '%12%' OR CAST(frame_index + 1 AS VARCHAR) LIKE '%12%')""", "ann"),
)
def p13(spark, sf):
    ann = B.annotations(spark, sf)
    videos = ann.select("video_id").distinct().withColumn("original_name", F.concat(F.lit("Walk-"), F.col("video_id").cast("string")))
    return P.search_history(ann, videos, " 12 ", "confirmed").select("mission_id", "video_id", "frame_index")


@query(
    "p14_bin_by",
    "SELECT event_id, CASE WHEN value / (10 + value) >= 0.75 THEN 'high' WHEN value / (10 + value) >= 0.5 THEN 'medium' ELSE 'low' END AS word, CASE WHEN value / (10 + value) >= 0.7 THEN 'secure' WHEN value / (10 + value) >= 0.42 THEN 'uncertain' ELSE 'not_reconstructed' END AS status FROM events",
)
def p14(spark, sf):
    share = F.col("value") / (10 + F.col("value"))
    return table(spark, sf, "events").select(
        "event_id",
        P.bin_by(share, (0.75, 0.5), ("high", "medium", "low")).alias("word"),
        P.bin_by(share, (0.7, 0.42), ("secure", "uncertain", "not_reconstructed")).alias("status"),
    )


@query(
    "p15_roi_band",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'Oberer' ELSE 'Unterer' END || ' Bildrand, ' || CAST(round_even(f * 100, 0) AS INTEGER) || ' % ignoriert' AS note,
      round_even(CASE WHEN event_id % 2 = 0 THEN 0.0 ELSE 1.0 - f END, 6) AS band_top, round_even(CASE WHEN event_id % 2 = 0 THEN f ELSE 1.0 END, 6) AS band_bottom
    FROM (SELECT event_id, (1 + event_id % 97) / 100.0::DOUBLE AS f FROM events)""",
)
def p15(spark, sf):
    e = F.col("event_id")
    f = (1 + e % 97) / F.lit(100.0)
    band = F.when(e % 2 == 0, P.roi_band("top", f)).otherwise(P.roi_band("bottom", f))
    return table(spark, sf, "events").select("event_id", band.alias("b")).select(
        "event_id", F.col("b.note").alias("note"), F.bround(F.col("b.points")[0]["y"], 6).alias("band_top"), F.bround(F.col("b.points")[2]["y"], 6).alias("band_bottom")
    )


@query("p16_quality_flags", sql("SELECT detection_id, CASE WHEN x1 <= 0.006 OR y1 <= 0.006 OR x2 >= 0.994 OR y2 >= 0.994 THEN 'border_truncated' ELSE '' END AS flags FROM dets", "dets"))
def p16(spark, sf):
    flags = P.quality_flags(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    return B.detections(spark, sf).select("detection_id", F.array_join(flags, ",").alias("flags"))


@query("e_clock_text", sql("SELECT event_id, (CAST(floor(timestamp_ms / 1000 + 0.5) AS BIGINT) // 60) || ':' || lpad(CAST(CAST(floor(timestamp_ms / 1000 + 0.5) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock FROM frames", "frames"))
def e_clock(spark, sf):
    return B.frames(spark, sf).select("event_id", P.clock(F.col("timestamp_ms")).alias("clock"))
