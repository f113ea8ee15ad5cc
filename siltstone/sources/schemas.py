"""Schemas of the sources as Spark DDL."""

REPOS = "repo_path STRING, github_metadata STRUCT<is_fork:BOOLEAN, stars:INT>, files ARRAY<STRUCT<file_path:STRING, language:STRING, content:STRING, size_bytes:BIGINT, is_vendor:BOOLEAN, license_type:STRING>>"
WEB = "text STRING, url STRING, quality_score DOUBLE"
MATH = "text STRING, url STRING, metadata MAP<STRING,STRING>"
FUNCTIONS = "code STRING, docstring STRING, identifier STRING, language STRING, path STRING"
CANONICAL = "doc_key STRING, order_key BIGINT, source STRING, text STRING, language STRING, file_path STRING, url STRING, size_bytes BIGINT, stars INT, license_type STRING, identifier STRING, quality_score DOUBLE, metadata MAP<STRING,STRING>"
PACKED = "seq_no BIGINT, input_ids ARRAY<INT>, labels ARRAY<INT>, attention_mask ARRAY<TINYINT>"
