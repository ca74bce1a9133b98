"""Explicit schemas of the stored records. Missing fields mean the older state and get defaults on read."""

COORDINATE = "struct<lat:double,lng:double>"
MASK = "struct<width:int,height:int,rle:array<int>>"
POLYGON = (
    "struct<id:string,class_id:string,points:array<array<double>>,certainty:string,origin:string,hard_negative:boolean,note:string,"
    "uncertainty_reason:string,tracking_id:string,carried_from_frame:bigint,edit:string>"
)
VIDEO = (
    "struct<id:string,direction:string,orientation:string,terrain_category:string,fully_not_traversable:boolean,original_name:string,"
    "content_type:string,size_bytes:bigint,sha256:string>"
)
PAUSE = "struct<start_seconds:double,end_seconds:double,note:string>"

MISSION = (
    f"id string, name string, status string, created_at timestamp, schema_version string, start {COORDINATE}, `end` {COORDINATE}, route array<{COORDINATE}>, "
    f"movement_start string, movement_end string, pauses array<{PAUSE}>, notes string, videos array<{VIDEO}>"
)
ANNOTATION = (
    "schema_version string, mission_id string, video_id string, frame_index bigint, timestamp_ms bigint, source_frame_hash string, "
    f"polygons array<{POLYGON}>, roi array<{POLYGON}>, frame_size struct<width:int,height:int>, status string, annotator string, notes string, "
    f"label_mode string, revision int, updated_at timestamp, mask {MASK}"
)
REFINEMENT = (
    "mission_id string, video_id string, frame_index bigint, items array<struct<id:string,created_at:timestamp,source_model_run_id:string,kind:string,"
    f"action:string,correct_value:int,seed:struct<x:double,y:double>,pixel_count:bigint,region_mask:{MASK}>>"
)
CRITICAL_FLAG = (
    f"mission_id string, video_id string, frame_index bigint, timestamp_ms bigint, kind string, severity int, note string, annotator string, created_at timestamp, brush_mask {MASK}"
)
OFF_PATH_INTERVAL = ("id string, mission_id string, video_id string, start_ms bigint, end_ms bigint, note string, annotator string, created_at timestamp")
TRAJECTORY = (
    "id string, mission_id string, video_id string, frame_index bigint, timestamp_ms bigint, points array<array<double>>, corridor string, origin string, "
    "note string, annotator string, revision int, created_at timestamp, updated_at timestamp"
)
ROI_PROFILE = (
    f"mission_id string, video_id string, top_ignore_fraction double, bottom_ignore_fraction double, roi array<{POLYGON}>, note string, revision int, created_at timestamp, updated_at timestamp"
)
METRICS = (
    "struct<tp:bigint,tn:bigint,fp:bigint,fn:bigint,missed_label_fraction:double,invented_path_fraction:double,symmetric_penalty_points:double,"
    "symmetric_score:double,iou:double,dice:double,precision:double,recall:double>"
)
MODEL_RUN = (
    "run_id string, scope string, kind string, created_at timestamp, model struct<input_width:int,random_features:int,ridge_lambda:double,threshold:double,confidence_threshold:double>, "
    f"train_metrics {METRICS}, validation_metrics {METRICS}, accuracy double, runtime_seconds double"
)
FRAME_RESULT = (
    "schema_version string, run_id string, mission_id string, video_id string, frames array<struct<frame_index:bigint,timestamp_ms:bigint,source_frame_hash:string,mask:struct<width:int,height:int>>>"
)
POINTER = ("run_id string, set_at timestamp, seq bigint")
