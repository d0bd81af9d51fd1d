"""Queries and SQL of the training-data problems: frequent values (1), dress (4), terms (6), packing (7), mixing (8),
look-alikes (9)."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import lookalike, mixing, packing, terms
from latticework.llm.dress import Collapsed, edge_form, text_form
from latticework.llm.iceberg import frequent_values
from latticework.sources.tables import table

CAPACITY = 2048


def p1_frequent(spark: SparkSession, d: str) -> DataFrame:
    found = frequent_values(table(spark, d, "edge_list"), "s", 0.005)
    return found.select(F.col("value").alias("s"), "n", (F.col("at_most") >= F.col("n")).alias("within_bound"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_frequent(spark, d).select("s")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return Collapsed(table(spark, d, "edge_text"), "rec_id", edge_form("line")).copies()


def p4_edges(spark: SparkSession, d: str) -> DataFrame:
    return Collapsed(table(spark, d, "edge_text"), "rec_id", edge_form("line")).groups.select("first_id", "copies")


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "raw_lines")
    return Collapsed(lines, "row_id", F.concat_ws("\x1e", "kind", text_form(F.col("line")))).groups.select("first_id", "copies")


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "vertex_label")
    found = terms.term_counts(labels, "l", "a", "set_at")
    vertices = labels.where("a IS NOT NULL AND l IS NOT NULL").select("a").distinct().count()
    return found.select(F.col("term").alias("l"), F.col("n").alias("n_rows"), F.col("n_records").alias("n_vertices"), terms.mark(found, vertices, 2, 0.1).alias("mark"))


def p6_runs(spark: SparkSession, d: str) -> DataFrame:
    found = terms.run_counts(table(spark, d, "vertex_label"), "a", "l", ["set_at", "l"])
    return found.select(F.array_join(F.transform("run", lambda x: x.cast("string")), " ").alias("run"), "length", "n", "n_records")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_terms(spark, d).where(F.col("mark").isNotNull()).select("l", "mark")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", "text", CAPACITY)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p7_containers(spark, d), CAPACITY)


def p7_contents(spark: SparkSession, d: str) -> DataFrame:
    return packing.contents(table(spark, d, "documents"), "doc_id", "text", p7_containers(spark, d))


def p7_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each document's hash, of its pieces put together again."""
    pieces = p7_contents(spark, d).where("content IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "content"))).alias("x"))
    whole = F.aggregate("x", F.lit(b""), lambda so_far, x: F.concat(so_far, x["content"]))
    return pieces.select("doc_id", F.md5(whole).alias("hash"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents, those without tokens, containers with more than fits, documents cut though they fit, documents
    with pieces that leave a gap, and whether the containers are at most a hundredth, or two, more than can do."""
    packed = p7_containers(spark, d)
    filled = packing.fill(packed, CAPACITY).agg(
        F.count(F.when(F.col("slack") < 0, 1)).alias("overfull"), (F.count(F.lit(1)) <= F.ceil(F.sum("n_tokens") / CAPACITY) * 1.01 + 2).alias("near_least")
    )
    ends = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    of_docs = ends.agg(
        F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("n") == 0, 1)).alias("empty"),
        F.count(F.when((F.col("k") > 1) & (F.col("n") <= CAPACITY), 1)).alias("cut_needlessly"), F.count(F.when(F.col("n") != F.col("end"), 1)).alias("gaps"),
    )
    one = filled.first()
    return of_docs.select("*", F.lit(one.overfull).cast("long").alias("overfull"), F.lit(one.near_least).alias("near_least"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"), "doc_id", "text", "source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per target source: whether it has tokens, documents used more often than allowed, and whether its part of all
    tokens is as near to the target as documents, which are not cut, allow."""
    chosen, shares = _mix(spark, d)
    limits = chosen.join(F.broadcast(shares.select("source", "max_repeat")), "source")
    over = limits.groupBy("source").agg(F.count(F.when(F.col("repeats") > F.col("max_repeat"), 1)).alias("over"), F.max("n_tokens").alias("largest"))
    can = F.when(F.col("available_tokens") > 0, F.col("share")).otherwise(F.lit(0.0))
    both = shares.join(over, "source", "left")
    sums = both.agg(F.sum(can).alias("able"), F.sum("used_tokens").alias("used"), F.max("largest").alias("most")).first()
    near = F.abs(F.col("used_tokens") - can / F.lit(sums.able) * F.lit(sums.used)) <= 2 * F.lit(sums.most)
    return both.select("source", (F.col("available_tokens") > 0).alias("has_tokens"), F.coalesce("over", F.lit(0)).alias("over_limit"), near.alias("near"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, d, "documents"), "doc_id", "text")


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.forms(table(spark, d, "documents"), "doc_id", "text")


def p9_skeletons(spark: SparkSession, d: str) -> DataFrame:
    """Of every text's form, what is left once look-alikes are Latin, as a hash."""
    forms = p9_forms(spark, d).where("form IS NOT NULL")
    rows = forms.mapInArrow(lambda batches: (_skeletons(b) for b in batches), "doc_id bigint, look string")
    return rows.select("doc_id", F.md5("look").alias("look"))


def _skeletons(b: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(0), pa.array([lookalike.skeleton(x) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "look"])


def p9_suspects(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.suspects(table(spark, d, "documents"), "doc_id", "text")


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.classes(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_frequent, p4_found, p4_edges, p4_records, p6_found, p6_terms, p6_runs, p7_containers, p7_fill, p7_contents, p7_texts, p7_checks, p8_mix, p8_shares, p8_checks, p9_found, p9_forms, p9_skeletons, p9_suspects, p9_classes)
}

_NUMBER = r"(?:0x[0-9a-f]+|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)"
# RE2 has no lookbehind: a sign counts after a character that can't end a number or a dash, which is matched with it.
_EDGES = rf"""texts AS (SELECT rec_id, regexp_replace(regexp_replace(lower(line), '([0-9a-f])[_''’]([0-9a-f])', '\1\2', 'g'),
  '([0-9a-f])[_''’]([0-9a-f])', '\1\2', 'g') AS x FROM edge_text),
marked AS (SELECT rec_id, regexp_matches(x, '(^|[^a-z0-9])[stw]([^a-z0-9]|$)') AS named,
  regexp_replace(x, '(^|[^-0-9a-z.])([+-])([0-9.])', '\1\2\3', 'g') AS x FROM texts),
found AS (SELECT rec_id, named, x,
  list_transform(regexp_extract_all(x, '(?:(?:^|[^-0-9a-z.])[+-])?{_NUMBER}'), lambda m: regexp_extract(m, '[+-]?{_NUMBER}$')) AS p FROM marked),
parts AS (SELECT rec_id,
  CASE WHEN named THEN regexp_extract(x, '(?:^|[^a-z0-9])s[^0-9a-z<.+-]*([+-]?{_NUMBER})', 1) ELSE coalesce(p[1], '') END AS s,
  CASE WHEN named THEN regexp_extract(x, '(?:^|[^a-z0-9])t[^0-9a-z<.+-]*([+-]?{_NUMBER})', 1) ELSE coalesce(p[2], '') END AS t,
  CASE WHEN named THEN regexp_extract(x, '(?:^|[^a-z0-9])w[^0-9a-z<.+-]*([+-]?{_NUMBER})', 1) ELSE coalesce(p[3], '') END AS w FROM found),
keyed AS (SELECT rec_id, least(s, t) AS a, greatest(s, t) AS b, w FROM parts)"""
_PUNCTUATION = """!"#$%&''()*+-./:<=>?@[\\]^_`{}~"""  # '' is one quote in SQL
_TERMS = """terms AS (SELECT l, count(*) AS n_rows, count(DISTINCT a) AS n_vertices FROM vertex_label WHERE l IS NOT NULL GROUP BY l),
marks AS (SELECT *, CASE WHEN n_vertices = 0 THEN NULL WHEN n_vertices <= 2 THEN 'rare'
  WHEN n_vertices >= 0.1 * (SELECT count(DISTINCT a) FROM vertex_label WHERE l IS NOT NULL) THEN 'common' END AS mark FROM terms)"""


# The SQL's own tables: look-alikes as pairs of code points, spaces and invisible characters as ranges.
_TWINS = """0410A 0412B 0415E 0405S 0406I 0408J 041AK 041CM 041DH 041EO 0420P 0421C 0422T 0423Y 0425X 050CG 051AQ 051CW 0474V 04AEY 04C0I
0430a 0435e 04BBh 0456i 0458j 043Eo 0440p 0441c 0501d 0455s 0443y 0445x 051Bq 051Dw 0475v
0391A 0392B 0395E 0396Z 0397H 0399I 039AK 039CM 039DN 039FO 03A1P 03A4T 03A5Y 03A7X 03F9C 037FJ 03BFo 03BDv 03F2c 03F3j"""
_BLANKS = "00A0 1680 2000-200A 202F 205F 3000"
_UNSEEN = "00AD 034F 061C 115F-1160 17B4-17B5 180B-180F 200B-200F 202A-202E 2060-206F 3164 FE00-FE0F FEFF FFA0 FFF0-FFF8"


def _codes(ranges: str) -> list[int]:
    ends = [r.split("-") for r in ranges.split()]
    return [c for e in ends for c in range(int(e[0], 16), int(e[-1], 16) + 1)]


def _look_sql() -> str:
    """The look in SQL: every look-alike as Latin, also under combining marks; equal where the one-script forms are."""
    twins = {chr(int(x[:4], 16)): x[4] for x in _TWINS.split()}
    marked = {}
    for c in map(chr, [*range(0x370, 0x530), *range(0x1F00, 0x2000)]):  # composed letters whose base is a look-alike
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1 and base[0] in twins:
            to = unicodedata.normalize("NFC", twins[base[0]] + base[1:])
            if len(to) == 1:
                marked[c] = to
    wide = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {chr(c): " " for c in _codes(_BLANKS)}
    text = lambda parts: "".join(parts).replace("'", "''")
    plain = f"nfc_normalize(translate(text, '{text([*wide, *map(chr, _codes(_UNSEEN))])}', '{text(wide.values())}'))"
    look = f"nfc_normalize(translate(plain, '{text([*twins, *marked])}', '{text([*twins.values(), *marked.values()])}'))"
    return f"plains AS (SELECT doc_id, text, {plain} AS plain FROM documents WHERE text IS NOT NULL),\nlooks AS (SELECT *, {look} AS look FROM plains)"


_LOOKS = _look_sql()
_DRAWN = {chr(int(x[:4], 16)) for x in _TWINS.split()}
_LATIN_LIKE = "".join(c for c in map(chr, [*range(0x370, 0x530), *range(0x1F00, 0x2000)]) if unicodedata.normalize("NFD", c)[0] in _DRAWN)

SQL = {
    "p1_found": "SELECT s FROM edge_list WHERE s IS NOT NULL GROUP BY s HAVING count(*) >= 0.005 * (SELECT count(s) FROM edge_list)",
    "p1_frequent": "SELECT s, count(*) AS n, true AS within_bound FROM edge_list WHERE s IS NOT NULL GROUP BY s HAVING count(*) >= 0.005 * (SELECT count(s) FROM edge_list)",
    "p4_found": f"""WITH {_EDGES}, firsts AS (SELECT rec_id, min(rec_id) OVER (PARTITION BY a, b, w) AS f FROM keyed)
SELECT f AS first_id, rec_id AS copy_id FROM firsts WHERE f <> rec_id""",
    "p4_edges": f"WITH {_EDGES} SELECT min(rec_id) AS first_id, count(*) AS copies FROM keyed GROUP BY a, b, w",
    "p4_records": f"""SELECT min(row_id) AS first_id, count(*) AS copies FROM raw_lines
GROUP BY kind, list_sort(list_filter(list_transform(string_split(translate(lower(line), ';|０１２３４５６７８９' || chr(9) || chr(10) || chr(13) || chr(160) || chr(8203), ',,0123456789,,,  '), ','),
  lambda f: list_filter(string_split(translate(f, '{_PUNCTUATION}', '{' ' * (len(_PUNCTUATION) - 1)}'), ' '), lambda w: w <> '')), lambda f: len(f) > 0))""",
    "p6_found": f"WITH {_TERMS} SELECT l, mark FROM marks WHERE mark IS NOT NULL",
    "p6_runs": """WITH seqs AS (SELECT a, list(l ORDER BY set_at NULLS FIRST, l) AS ls FROM vertex_label WHERE a IS NOT NULL AND l IS NOT NULL GROUP BY a),
starts AS (SELECT a, ls, unnest(range(1, len(ls) + 1)) AS i FROM seqs),
pieces AS (SELECT a, ls[i:k] AS run FROM (SELECT a, ls, i, unnest(range(i, len(ls) + 1)) AS k FROM starts)
  UNION ALL SELECT NULL, [l] FROM vertex_label WHERE a IS NULL AND l IS NOT NULL),
counts AS (SELECT run, len(run) AS length, count(*) AS n, count(DISTINCT a) AS n_records FROM pieces GROUP BY run)
SELECT array_to_string(c.run, ' ') AS run, c.length::INTEGER AS length, c.n, c.n_records FROM counts c
LEFT JOIN counts p ON p.run = c.run[1:c.length - 1] WHERE c.n > 1 OR c.length = 1 OR p.n > 1""",
    "p6_terms": f"WITH {_TERMS} SELECT l, n_rows, n_vertices, mark FROM marks",
    "p7_texts": "SELECT doc_id, md5(text) AS hash FROM documents WHERE text IS NOT NULL",
    "p7_checks": """SELECT count(*) AS documents, count(*) FILTER (text IS NULL OR text = '') AS empty, 0::BIGINT AS cut_needlessly, 0::BIGINT AS gaps,
0::BIGINT AS overfull, true AS near_least FROM documents""",
    "p8_checks": """SELECT source, source IN (SELECT source FROM documents WHERE text <> '' AND source IS NOT NULL) AS has_tokens, 0::BIGINT AS over_limit, true AS near
FROM (SELECT DISTINCT source FROM mix_target WHERE source IS NOT NULL AND share > 0)""",
    "p9_found": f"""WITH {_LOOKS} SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM looks a JOIN looks b
ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text WHERE a.text <> '' AND b.text <> ''""",
    "p9_classes": f"WITH {_LOOKS} SELECT min(doc_id) AS class_id, count(*) AS n_docs, count(DISTINCT text) AS n_texts FROM looks WHERE text <> '' GROUP BY look",
    "p9_skeletons": f"WITH {_LOOKS} SELECT doc_id, md5(look) AS look FROM looks",
    "p9_suspects": rf"""WITH {_LOOKS}, tokens AS (SELECT doc_id, unnest(regexp_extract_all(plain, '[\p{{L}}\p{{N}}_\x{{300}}-\x{{36f}}]+')) AS token FROM looks),
scripts AS (SELECT doc_id, regexp_matches(token, '\p{{Latin}}')::INT + regexp_matches(token, '\p{{Cyrillic}}')::INT + regexp_matches(token, '\p{{Greek}}')::INT AS n,
  regexp_full_match(token, '[{_LATIN_LIKE}\p{{N}}_\x{{300}}-\x{{36f}}]+') AS drawn FROM tokens)
SELECT doc_id, count(*) FILTER (n > 1) AS n_mixed, count(*) FILTER (n = 1 AND drawn) AS n_whole FROM scripts GROUP BY doc_id
HAVING count(*) FILTER (n > 1) + count(*) FILTER (n = 1 AND drawn) > 0""",
}
