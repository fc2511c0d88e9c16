"""The library's rules as functions of SQL: scalar and table functions that the planner inlines, for users who write SQL.

register() adds them to a session; own rules can be passed to it, so checks and formats are extension points, as text.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name and parameters, what they return, and the rule. Checks give the reason why something fails, or an empty text.
SCALARS = {
    "lf_clock(s BIGINT)": ("STRING", "CASE WHEN s >= 3600 THEN concat(s DIV 3600, ':', lpad(s % 3600 DIV 60, 2, '0')) ELSE CAST(s DIV 60 AS STRING) END || ':' || lpad(s % 60, 2, '0')"),
    "lf_js_round(x DOUBLE)": ("BIGINT", "floor(x + 0.5)"),
    "lf_leading_number(t STRING)": ("DOUBLE", "try_cast(nullif(regexp_extract(t, '^\\\\s*([0-9]+(\\\\.[0-9]+)?)', 1), '') AS DOUBLE)"),
    "lf_media_check(duration DOUBLE, expected DOUBLE, video BOOLEAN, audio BOOLEAN)": (
        "STRING", "CASE WHEN NOT video THEN 'no video stream' WHEN NOT audio THEN 'no audio stream' WHEN abs(duration - expected) > 2.0 THEN 'duration differs' ELSE '' END",
    ),
    "lf_shown(value STRING, format STRING)": ("STRING", "CASE format WHEN 'upper' THEN upper(value) WHEN 'count' THEN concat(value, ' items') WHEN 'pct' THEN concat(value, '%') ELSE value END"),
}
#: Name and parameters, the table's columns, and its query.
TABLES = {
    "lf_matches(t STRING, pattern STRING)": ("place INT, value STRING", "SELECT pos + 1, col FROM posexplode(regexp_extract_all(t, pattern, 0)) AS x(pos, col)"),
    "lf_windows(n BIGINT, width BIGINT)": ("lo BIGINT, hi BIGINT", "SELECT i * width, least(n, (i + 1) * width) FROM (SELECT explode(sequence(0L, greatest(0L, (n - 1) DIV width))) AS i) WHERE n > 0"),
}


def register(spark: SparkSession, scalars: dict[str, tuple[str, str]] | None = None, tables: dict[str, tuple[str, str]] | None = None) -> None:
    """Adds the functions to the session, and own ones of the same form; an own one replaces that of its name."""
    for name, (kind, rule) in {**SCALARS, **(scalars or {})}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {kind} RETURN {rule}")
    for name, (columns, body) in {**TABLES, **(tables or {})}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS TABLE ({columns}) RETURN {body}")
