"""Queries and SQL of the data-preparation problems in the core: orphans (2), frequent keys (3), bad rows (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators.orphans import Orphans, Reference
from latticework.operators.rowparse import clean_fields, mend, parse_rows, typed
from latticework.operators.skew import totals
from latticework.sources.tables import table

RULES = {
    "edge_list": [("s", "id"), ("t", "id"), ("weight", "number"), ("note", "text")],
    "vertex_label": [("a", "id"), ("l", "id"), ("note", "text")],
}


def _orphans(spark: SparkSession, d: str) -> Orphans:
    refs = [
        Reference("edge_list", table(spark, d, "edge_list"), "s", "loaded_at", "line_id"),
        Reference("cand", table(spark, d, "cand"), "v", "loaded_at", "cand_id"),
    ]
    return Orphans(refs, table(spark, d, "vertex_label"), "a", "set_at", "gone_at")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).found()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).report()


def p3_totals(spark: SparkSession, d: str) -> DataFrame:
    found = totals(table(spark, d, "edge_list"), [("s", "t"), ("t", "s")], "weight", "line_id")
    return found.select("side", F.col("k").alias("vertex_id"), "n_rows", "n_neighbours", F.round("sum_weight", 4).alias("sum_weight"))


def p3_found(spark: SparkSession, d: str, share: float = 0.02) -> DataFrame:
    n = table(spark, d, "edge_list").agg(F.count("s"), F.count("t")).first()
    least = F.when(F.col("side") == "s", F.lit(share * n[0])).otherwise(F.lit(share * n[1]))
    return p3_totals(spark, d).where(F.col("n_rows") >= least).select("side", "vertex_id")


def p5_parsed(spark: SparkSession, d: str) -> DataFrame:
    return parse_rows(table(spark, d, "raw_lines"), RULES)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_parsed(spark, d).where(F.col("reason").isNotNull()).select("row_id", "reason")


def p5_repairs(spark: SparkSession, d: str) -> DataFrame:
    return p5_parsed(spark, d).where(F.col("reason").isNotNull()).select("row_id", "kind", "reason", "edits")


def p5_mends(spark: SparkSession, d: str) -> DataFrame:
    """Of the lines that don't split into the right fields, how many do by their edits."""
    lines = mend(table(spark, d, "raw_lines"), p5_parsed(spark, d))
    columns = F.when(F.col("kind") == "edge_list", len(RULES["edge_list"])).otherwise(len(RULES["vertex_label"]))
    clean = F.size(clean_fields(F.col("line"))) + F.col("more") == columns
    return lines.groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(clean, 1)).alias("n_clean"))


def p5_edges(spark: SparkSession, d: str) -> DataFrame:
    return typed(p5_parsed(spark, d), "edge_list", RULES["edge_list"])


def p5_labels(spark: SparkSession, d: str) -> DataFrame:
    return typed(p5_parsed(spark, d), "vertex_label", RULES["vertex_label"])


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p3_found, p3_totals, p5_found, p5_repairs, p5_mends, p5_edges, p5_labels)}

_REFS = """refs AS (
  SELECT 'edge_list' AS tab, line_id AS row_id, s AS k, loaded_at AS ts FROM edge_list WHERE s IS NOT NULL
  UNION ALL SELECT 'cand', cand_id, v, loaded_at FROM cand WHERE v IS NOT NULL),
orphans AS (SELECT * FROM refs WHERE NOT EXISTS (
  SELECT 1 FROM vertex_label x WHERE x.a = refs.k AND x.set_at <= refs.ts AND (x.gone_at IS NULL OR x.gone_at > refs.ts)))"""
_FIELD = r"""(?:"[^"]*(?:""[^"]*)*"|[^",]*)"""
_SPLIT = rf"""lines AS (SELECT row_id, kind, line, regexp_full_match(line, '{_FIELD}(?:,{_FIELD})*', 's') AS clean FROM raw_lines),
fields AS (SELECT row_id, kind, clean, line,
  CASE WHEN clean THEN list_transform(regexp_extract_all(',' || line, ',({_FIELD})', 1, 's'),
    lambda x: CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) END AS f FROM lines),
checked AS (SELECT *, CASE WHEN NOT clean THEN 'quoting'
  WHEN len(f) <> CASE kind WHEN 'edge_list' THEN 4 ELSE 3 END THEN 'columns'
  WHEN NOT (regexp_full_match(f[1], ' *0*[0-9]{{1,19}} *') AND regexp_full_match(f[2], ' *0*[0-9]{{1,19}} *')
    AND coalesce(try_cast(trim(f[1]) AS HUGEINT) < 9223372036854775808::HUGEINT, false)
    AND coalesce(try_cast(trim(f[2]) AS HUGEINT) < 9223372036854775808::HUGEINT, false)
    AND (kind <> 'edge_list' OR f[3] = '' OR regexp_full_match(f[3], ' *[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)? *')))
  THEN 'value' END AS reason FROM fields)"""

SQL = {
    "p2_found": f"WITH {_REFS} SELECT tab, row_id, CAST(year(ts) * 100 + month(ts) AS INTEGER) AS yyyymm FROM orphans",
    "p2_report": f"""WITH {_REFS}, first AS (SELECT a, min(set_at) AS since FROM vertex_label WHERE a IS NOT NULL GROUP BY a)
SELECT tab, CAST(year(ts) * 100 + month(ts) AS INTEGER) AS yyyymm, count(*) AS n_refs, count(DISTINCT k) AS n_keys,
count(*) FILTER (since IS NULL) AS n_missing, count(*) FILTER (since <= ts) AS n_gone, count(*) FILTER (since > ts) AS n_early
FROM orphans LEFT JOIN first ON first.a = k GROUP BY tab, yyyymm""",
    "p3_totals": """SELECT 's' AS side, s AS vertex_id, count(*) AS n_rows, count(DISTINCT t) AS n_neighbours, round(sum(weight), 4) AS sum_weight
FROM edge_list WHERE s IS NOT NULL GROUP BY s UNION ALL
SELECT 't', t, count(*), count(DISTINCT s), round(sum(weight), 4) FROM edge_list WHERE t IS NOT NULL GROUP BY t""",
    "p3_found": """SELECT 's' AS side, s AS vertex_id FROM edge_list WHERE s IS NOT NULL GROUP BY s
HAVING count(*) >= 0.02 * (SELECT count(s) FROM edge_list) UNION ALL
SELECT 't', t FROM edge_list WHERE t IS NOT NULL GROUP BY t HAVING count(*) >= 0.02 * (SELECT count(t) FROM edge_list)""",
    "p5_found": f"WITH {_SPLIT} SELECT row_id, reason FROM checked WHERE reason IS NOT NULL",
    "p5_mends": f"WITH {_SPLIT} SELECT kind, reason, count(*) AS n, count(*) AS n_clean FROM checked WHERE reason IN ('quoting', 'columns') GROUP BY kind, reason",
    "p5_edges": f"""WITH {_SPLIT} SELECT row_id, CAST(trim(f[1]) AS BIGINT) AS s, CAST(trim(f[2]) AS BIGINT) AS t,
CASE WHEN f[3] <> '' THEN CAST(trim(f[3]) AS DOUBLE) END AS weight, f[4] AS note FROM checked WHERE kind = 'edge_list' AND reason IS NULL""",
    "p5_labels": f"""WITH {_SPLIT} SELECT row_id, CAST(trim(f[1]) AS BIGINT) AS a, CAST(trim(f[2]) AS BIGINT) AS l, f[3] AS note
FROM checked WHERE kind = 'vertex_label' AND reason IS NULL""",
}
