"""Explicit schemas of the document model; scans never infer."""

from __future__ import annotations

META = "doc_id string, file_name string, doc_type string, page_count int, ingested_at string, source string"
TEXT = "id string, doc_id string, page int, content string, section string, category string, role string, bbox array<double>, extra map<string,string>"
TABLE = (
    "id string, doc_id string, page int, name string, section string, category string, role string, columns array<string>, rows array<array<string>>, "
    "markdown string, html_content string, image_path string, is_complex boolean, source string, method string, numeric_trust string, "
    "structured_available boolean, raw_available boolean, structure_lossy boolean, bbox array<double>, extra map<string,string>"
)
IMAGE = "id string, doc_id string, page int, file_path string, caption string, section string, category string, role string, bbox array<double>, extra map<string,string>"
ISSUE = "level string, code string, message string, context map<string,string>"
COST = (
    "ts timestamp, endpoint string, provider string, model string, prompt_tokens int, completion_tokens int, "
    "rate_input_per_m double, rate_output_per_m double, cost_usd double, user_id string, ctx string"
)
QA = "ts timestamp, query string, doc_ids array<string>, answer string, intent string"
