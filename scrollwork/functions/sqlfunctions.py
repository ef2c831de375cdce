"""The column functions as functions of SQL, so that queries written as text can use them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from scrollwork.functions.text import DNA_SPLIT, FP_DROP, LINE_END, WS_CHARS


def _literal(s: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" for c in s) + "'"


#: Name and arguments, then the body; a TABLE function gives several rows a text.
FUNCTIONS = {
    "strip_ws(s STRING) RETURNS STRING": f"trim(BOTH {_literal(WS_CHARS)} FROM s)",
    "count_words(s STRING) RETURNS INT": f"length(translate(s, {_literal(WS_CHARS)}, ''))",
    "title_fingerprint(s STRING) RETURNS STRING": f"CASE WHEN regexp_replace(lower(strip_ws(coalesce(s, ''))), {_literal(FP_DROP)}, '') = '' THEN '' ELSE substring(sha1(regexp_replace(lower(strip_ws(coalesce(s, ''))), {_literal(FP_DROP)}, '')), 1, 10) END",
    "hook_values(s STRING) RETURNS ARRAY<STRING>": f"array_distinct(filter(split(coalesce(s, ''), {_literal(DNA_SPLIT)}), x -> length(x) >= 2))",
    "set_overlap(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN size(a) > 0 AND size(b) > 0 THEN size(array_intersect(a, b)) / size(array_union(a, b)) ELSE 0D END",
    "text_lines(s STRING) RETURNS TABLE(no INT, line STRING)": f"SELECT pos + 1, col FROM posexplode(split(s, {_literal(LINE_END)}))",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names. They run in the JVM like built-in ones."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in FUNCTIONS]
