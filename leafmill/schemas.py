"""Contracts of the page tables and the limits that change results."""

from __future__ import annotations

RESPONSES = "source_path string, page int, stage string, response string, reasoning string, input_tokens long, output_tokens long, estimated_image_tokens long, elapsed_ms long, error string"
ATTENTION = "ord int, name string, aliases array<string>, required boolean"
FIELD_SPECS = "ord int, name string, label_pattern string, position_hint string, format_hint string, example string, allowed_values array<string>, context_rule string, required boolean"
RULES = "field string, pattern string, min_length int, max_length int, allowed_values array<string>"
VOTES = "field string, vote_idx int, raw string, temperature double"
PASSES = "field string, pass_idx int, value string, confidence string"
JOB_EVENTS = "batch_id string, ts timestamp, status string, total int, completed int, failed int"
CALL_EVENTS = "ts timestamp, status int, latency_ms double"

PAGE_SCHEMA_V1, PAGE_SCHEMA_V2, DOCUMENT_SCHEMA = "universal_document_semantics_v1", "universal_document_semantics_v2", "lossless_document_v1"

#: Limits and defaults (fixed values).
LIMITS = {
    "tokens_per_image": 16384,
    "page_megapixels": 25,
    "image_bytes": 20 * 2**20,
    "video_bytes": 100 * 2**20,
    "concurrency": 10,
    "concurrency_most": 50,
    "retries": 3,
    "retry_base_ms": 1000,
    "pack_pages": 20,
    "batch_pages": 50,
    "video_chunk_s": 1800,
    "pack_tokens": 32_000,
    "votes": 2,
    "unverified_required": 0,
    "crop_padding": 0.4,
    "max_side": 4096,
    "poll_s": 5,
    "wait_s": 300,
    "entropy_review": 0.5,
    "vote_adopt": 0.66,
    "template_ttl_s": 300,
}
