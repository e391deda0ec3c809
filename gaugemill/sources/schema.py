"""Fixed schemas: one superset for all row shapes, so that nothing is inferred from what a file happens to hold."""

from __future__ import annotations

TASK_ROWS = (
    "id string, task_name string, prompt string, query_text string, source_item_ids array<string>, candidate_item_ids array<string>, candidate_audio_paths array<string>, "
    "candidate_labels array<string>, query_audio_path string, prompt_audio_path string, text_options array<string>, label_space array<string>, gold_index bigint, gold_label string, "
    "gold_ranking array<bigint>, balance_bucket string, distractor_label string, delivery_label string, source_dataset string, source_item_id string, youtube_id string, match_reason string, "
    "window_start_seconds double, window_duration_seconds double"
)
PREDICTIONS = "task_dir string, task_name string, id string, prediction struct<scores:array<double>,predicted_index:bigint,predicted_ranking:array<bigint>,raw_response:string>, metrics map<string,string>"
PAIRWISE = "source_item_id string, display_name string, positive_sample struct<audio_path:string,short_context_text:string,rich_context_text:string>, context_text string, extra struct<periodicity:string,transient:string>, task_id string"
LABEL_CSV = "youtube_id string, start_seconds string, label string, split string"
TIER3_JSON = "video_uid string, split string, scenario string, videos array<struct<video_uid:string,split:string,scenario:string,clips:array<struct<clip_uid:string,video_uid:string,split:string,scenario:string,text:string>>>>"
