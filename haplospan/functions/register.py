"""The naming functions as temporary SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

STEPS = "ARRAY<STRUCT<segment: STRING, strand: STRING>>"
#: The fields of a record where its tags start, from 1.
TAGS_AT = "CASE substring(line, 1, 1) WHEN 'S' THEN IF(split(line, '\t')[2] RLIKE '^[0-9]+$', 5, 4) WHEN 'L' THEN 7 WHEN 'E' THEN 10 WHEN 'W' THEN 8 ELSE 1 + size(split(line, '\t')) END"


def one_decimal(unit: int) -> str:
    return f"CASE WHEN bp % {unit} = {unit // 4} THEN concat(floor(bp / {unit}), '.3') ELSE regexp_replace(replace(format_number(bp / {unit}.0D, 1), ',', ''), '[.]0$', '') END"


# name, arguments, result, expression
FUNCTIONS = [
    ("pansn_sample", "name STRING", "STRING", "substring_index(name, '#', 1)"),
    ("pansn_contig", "name STRING", "STRING", "CASE WHEN size(split(name, '#')) >= 3 THEN array_join(slice(split(name, '#'), 3, size(split(name, '#'))), '#') WHEN size(split(name, '#')) = 2 THEN split(name, '#')[1] ELSE name END"),
    ("path_origin_start", "name STRING", "BIGINT", "CASE WHEN name RLIKE '^.*:[0-9]+-[0-9]+$' THEN CAST(regexp_extract(name, '^.*:([0-9]+)-[0-9]+$', 1) AS BIGINT) ELSE 0 END"),
    ("edge_key", "a STRING, b STRING", "STRING", "concat(least(a, b), '--', greatest(a, b))"),
    ("locstring", "ref STRING, start BIGINT, stop BIGINT", "STRING", "concat(ref, ':', start + 1, '-', stop)"),
    ("pansn_haplotype", "name STRING", "BIGINT", "CASE WHEN get(split(name, '#'), 1) = '' THEN 0 ELSE CAST(try_cast(get(split(name, '#'), 1) AS DOUBLE) AS BIGINT) END"),
    ("path_origin_name", "name STRING", "STRING", "CASE WHEN name RLIKE '^.*:[0-9]+-[0-9]+$' THEN regexp_extract(name, '^(.*):[0-9]+-[0-9]+$', 1) ELSE name END"),
    ("gfa_tag", "line STRING, tag STRING", "STRING", f"substring(try_element_at(filter(slice(split(line, '\t'), {TAGS_AT}, 1 + length(line)), x -> startswith(x, concat(tag, ':i:')) OR startswith(x, concat(tag, ':f:')) OR startswith(x, concat(tag, ':Z:'))), -1), length(tag) + 4)"),
    ("gfa_path", "steps STRING", STEPS, "transform(split(steps, ','), s -> named_struct('segment', substring(s, 1, length(s) - 1), 'strand', IF(endswith(s, '-'), '-', '+')))"),
    ("gfa_walk", "steps STRING", STEPS, "transform(regexp_extract_all(steps, '(?:^|[><])[^><]+', 0), s -> named_struct('segment', regexp_replace(s, '^[><]', ''), 'strand', IF(startswith(s, '<'), '-', '+')))"),
    ("format_bp", "bp BIGINT", "STRING", f"CASE WHEN bp >= 1000000 THEN concat({one_decimal(1000000)}, ' Mb') WHEN bp >= 1000 THEN concat({one_decimal(1000)}, ' kb') ELSE concat(bp, ' bp') END"),
    ("format_span_bp", "bp BIGINT", "STRING", f"CASE WHEN bp >= 1000000 THEN concat({one_decimal(1000000)}, ' Mb') ELSE concat(floor(bp / 1000 + 0.5), ' kb') END"),
]


def register(spark: SparkSession) -> None:
    for name, arguments, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
