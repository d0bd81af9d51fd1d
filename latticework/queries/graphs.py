"""Queries and SQL of the graph operators.

Two graphs: the *domain* graph has all lines of edge_list as undirected edges and, as a vertex's label, the one
last set of those that are not gone; the *part* graph joins parts of one order (all of lineitem), labelled by the
rank of their type. Queries over the twelve patterns of pattern_v and pattern_e take all of them at once.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.bits import bit_set, owner, scramble_column
from latticework.graph import Graph
from latticework.operators import dense, learned, match as matching, prune, traverse
from latticework.plans import constraints
from latticework.plans.pattern import Pattern, Walk, read_pattern, read_pattern_files, write_pattern, write_pattern_files
from latticework.session import cut, ensure_checkpoint_dir, stored
from latticework.sources import generate, sample, text
from latticework.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# --- the graphs -------------------------------------------------------------------------------------------------


def domain(spark: SparkSession, d: str) -> Graph:
    edges = table(spark, d, "edge_list").select(F.col("s").alias("src"), F.col("t").alias("dst"), "weight")
    labels = table(spark, d, "vertex_label").where("a IS NOT NULL AND l IS NOT NULL AND gone_at IS NULL")
    labels = labels.groupBy(F.col("a").alias("id")).agg(F.max_by("l", F.struct("set_at", "l")).alias("label"))
    return Graph(edges, labels)


def parts(spark: SparkSession, d: str) -> Graph:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()  # moved once for this and the join
    a, b = lines.select("l_orderkey", F.col("l_partkey").alias("src")), lines.select("l_orderkey", F.col("l_partkey").alias("dst"))
    edges = a.join(b, "l_orderkey").where("src < dst").select("src", "dst").distinct()
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_type")
    ranks = {r.p_type: i for i, r in enumerate(part.select("p_type").distinct().orderBy("p_type").collect())}
    label = F.create_map(*(F.lit(x) for k, v in ranks.items() for x in (k, v)))[F.col("p_type")] if ranks else F.lit(0)
    return Graph(edges, part.select("id", label.cast("long").alias("label")), once=True)


def given(spark: SparkSession, d: str, directed: bool = False) -> dict[int, Pattern]:
    """The patterns of pattern_v and pattern_e by their numbers."""
    labels, edges = {}, {}
    for r in table(spark, d, "pattern_v").orderBy("query_no", "u").collect():
        labels.setdefault(r.query_no, []).append(r.label)
    for r in table(spark, d, "pattern_e").orderBy("query_no", "a", "b").collect():
        edges.setdefault(r.query_no, []).append((r.a, r.b))
    return {q: Pattern.of(labels[q], edges[q], directed) for q in sorted(labels)}


_LINES = "lines AS MATERIALIZED (SELECT s AS src, t AS dst, weight FROM edge_list WHERE s IS NOT NULL AND t IS NOT NULL)"
_DOMAIN = f"""{_LINES},
edges AS MATERIALIZED (SELECT src, dst, weight FROM lines UNION ALL SELECT dst, src, weight FROM lines),
simple AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE src <> dst),
pairs AS MATERIALIZED (SELECT src AS a, dst AS b FROM simple WHERE src < dst),
vertices AS MATERIALIZED (SELECT a AS id, arg_max(l, (set_at, l)) AS label FROM vertex_label
  WHERE a IS NOT NULL AND l IS NOT NULL AND gone_at IS NULL GROUP BY a)"""
_PARTS = """lines AS MATERIALIZED (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
simple AS MATERIALIZED (SELECT DISTINCT x.p AS src, y.p AS dst FROM lines x JOIN lines y ON x.o = y.o AND x.p <> y.p),
pairs AS MATERIALIZED (SELECT src AS a, dst AS b FROM simple WHERE src < dst),
vertices AS MATERIALIZED (SELECT p_partkey AS id, dense_rank() OVER (ORDER BY p_type) - 1 AS label FROM part)"""


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# --- edges, degrees, labels -------------------------------------------------------------------------------------


@query(f"WITH {_DOMAIN} SELECT src, dst, weight FROM edges")
def edges_undirected(spark, d):
    return domain(spark, d).edges


@query(f"WITH {_DOMAIN} SELECT src, dst FROM simple")
def edges_simple(spark, d):
    return domain(spark, d).simple


@query(f"WITH {_DOMAIN} SELECT a, b FROM pairs")
def orient_dedupe(spark, d):
    return domain(spark, d).pairs


@query(f"WITH {_DOMAIN} SELECT src AS id, count(*) AS degree FROM edges GROUP BY src")
def degree(spark, d):
    return domain(spark, d).degrees()


@query(f"WITH {_DOMAIN} SELECT src AS id, count(*) AS degree FROM edges WHERE src <> dst GROUP BY src")
def degree_no_loops(spark, d):
    return domain(spark, d).degrees(loops=False)


@query(f"""WITH {_LINES} SELECT id, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM
(SELECT src AS id, 1 AS o, 0 AS i FROM lines UNION ALL SELECT dst, 0, 1 FROM lines) GROUP BY id""")
def degree_in_out(spark, d):
    return domain(spark, d).degrees_in_out()


@query(f"WITH {_DOMAIN}, deg AS (SELECT src, count(*) AS degree FROM edges GROUP BY src) SELECT degree, count(*) AS n FROM deg GROUP BY degree")
def degree_hist(spark, d):
    return domain(spark, d).degree_histogram()


@query(f"WITH {_DOMAIN} SELECT src AS id, CAST(ceil(log2(count(*) + 1)) AS BIGINT) AS label FROM edges GROUP BY src")
def degree_label(spark, d):
    return domain(spark, d).with_degree_labels().vertices


@query(f"WITH {_DOMAIN} SELECT label, count(*) AS n FROM vertices GROUP BY label")
def label_hist(spark, d):
    return domain(spark, d).label_histogram()


@query(f"WITH {_DOMAIN} SELECT src, label, count(*) AS k FROM simple JOIN vertices ON id = dst GROUP BY src, label")
def nlf(spark, d):
    return prune.neighbour_counts(domain(spark, d))


@query(f"WITH {_DOMAIN} SELECT src, label, count(*) AS k FROM edges JOIN vertices ON id = dst GROUP BY src, label")
def nlf_multigraph(spark, d):
    return prune.neighbour_counts(domain(spark, d), multigraph=True)


@query(f"""WITH {_DOMAIN}, deg AS (SELECT src, count(*) AS n FROM edges GROUP BY src), ids AS (SELECT src FROM deg UNION SELECT id FROM vertices)
SELECT (SELECT count(*) FROM vertices) AS vertices, (SELECT max(id) FROM vertices) AS max_id, (SELECT count(*) FROM lines) AS lines, (SELECT count(*) FROM edges) AS edges,
(SELECT count(*) FROM pairs) AS pairs, (SELECT count(*) FROM lines WHERE src = dst) AS loops, (SELECT max(n) FROM deg) AS max_degree,
(SELECT count(*) FROM deg WHERE n >= 1000) AS hubs, (SELECT coalesce(sum(n), 0)::BIGINT FROM deg WHERE n >= 1000) AS hub_edges""")
def statistics(spark, d):
    return domain(spark, d).statistics(hub_degree=1000)


@query(f"""WITH {_DOMAIN}, deg AS (SELECT src, count(*) AS n FROM edges GROUP BY src)
SELECT id, coalesce(n, 0) AS degree, label, coalesce(n, 0) >= 1000 AS hub FROM vertices LEFT JOIN deg ON src = id""")
def vertex_table(spark, d):
    return domain(spark, d).vertex_table(hub_degree=1000)


@query(f"WITH {_DOMAIN} SELECT id, coalesce(u.l, label) AS label FROM vertices FULL JOIN (SELECT v AS id, min(query_no)::BIGINT AS l FROM cand WHERE v IS NOT NULL GROUP BY v) u USING (id)")
def label_update(spark, d):
    new = table(spark, d, "cand").select(F.col("v").alias("id"), F.col("query_no").cast("long").alias("label"))
    return domain(spark, d).with_labels(new).vertices


@query(f"WITH {_DOMAIN} SELECT DISTINCT query_no, v, u FROM cand WHERE v IS NOT NULL EXCEPT SELECT query_no, id, u FROM vertices JOIN pattern_v USING (label)")
def stated_not_by_label(spark, d):
    stated = table(spark, d, "cand").where("v IS NOT NULL").select("query_no", "v", "u").distinct()
    return stated.join(_by_label(spark, d), ["query_no", "v", "u"], "left_anti")


@query(f"WITH {_DOMAIN}, x AS (SELECT query_no, id AS v, u FROM vertices JOIN pattern_v USING (label)) SELECT query_no, u, count(*) AS n FROM (SELECT query_no, v, u FROM x UNION SELECT query_no, v, u FROM cand WHERE v IS NOT NULL) GROUP BY query_no, u")
def candidate_union(spark, d):
    stated = table(spark, d, "cand").where("v IS NOT NULL").select("query_no", "v", "u")
    return stated.unionByName(_by_label(spark, d)).distinct().groupBy("query_no", "u").agg(F.count(F.lit(1)).alias("n"))


def _by_label(spark: SparkSession, d: str) -> DataFrame:
    """(query_no, v, u): the label candidates of all patterns."""
    return domain(spark, d).vertices.join(table(spark, d, "pattern_v"), "label").select("query_no", F.col("id").alias("v"), "u")


def _hash_sql(x: str) -> str:
    """The 32-bit hash of x, step by step."""
    m = 0xFFFFFFFF
    steps = ["(x + 2127912214 + (x << 12)) & {m}", "xor(xor(x, 3345072700), x >> 19)", "(x + 374761393 + (x << 5)) & {m}", "xor((x + 3550635116) & {m}, (x << 9) & {m})", "(x + 4251993797 + (x << 3)) & {m}", "xor(xor(x, 3042594569), x >> 16)"]
    out = f"({x} & {m})"
    for step in steps:
        out = f"list_transform([{out}], lambda x: {step.format(m=m)})[1]"
    return out


@query(f"WITH {_DOMAIN} SELECT (xor({_hash_sql('a')}, {_hash_sql('b')}) % 16)::INTEGER AS part, count(*) AS n FROM pairs GROUP BY part")
def edge_owner(spark, d):
    e = domain(spark, d).pairs
    return e.groupBy(owner(F.col("a"), F.col("b"), 16).alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_DOMAIN} SELECT id, {_hash_sql('id')}::BIGINT AS scrambled FROM vertices WHERE id < 4294967296")
def scramble_ids(spark, d):
    ids = domain(spark, d).vertices.where(F.col("id") < 1 << 32)  # a permutation of the 32-bit numbers
    return ids.select("id", scramble_column(F.col("id"), 32).alias("scrambled"))


@query(f"WITH {_LINES} SELECT count(*) * 2 AS edges FROM lines")
def edge_balance(spark, d):
    return domain(spark, d).balance().agg(F.sum("edges").alias("edges"))


@query(f"""WITH {_LINES}, ends AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM lines UNION ALL SELECT dst FROM lines) GROUP BY id)
SELECT sum(n)::BIGINT AS ends, bit_xor(CASE WHEN n % 2 = 1 THEN id ELSE 0 END) AS id_xor, count(*) FILTER (n >= 1000) AS hubs FROM ends""")
def endpoint_checks(spark, d):
    return generate.degree_checks(domain(spark, d).lines, 1000)


@query(f"""WITH {_DOMAIN}, deg AS (SELECT id, count(src) AS n FROM vertices LEFT JOIN edges ON src = id GROUP BY id), t AS (SELECT unnest([0, 1, 2, 5, 100, 1000000])::BIGINT AS degree)
SELECT degree, (SELECT count(*) FROM deg WHERE n >= degree) AS n FROM t""")
def degree_tail(spark, d):
    return matching.degree_tail(domain(spark, d), [0, 1, 2, 5, 100, 1_000_000])


@query(f"WITH {_DOMAIN} SELECT s.src, s.dst FROM simple s JOIN vertices v ON v.id = s.src JOIN vertices w ON w.id = s.dst WHERE v.label IN (133, 810) AND w.label IN (133, 810)")
def induced_edges(spark, d):
    g = domain(spark, d)
    return g.induced(g.vertices.where("label IN (133, 810)")).where("src <> dst").select("src", "dst").distinct()


# --- pruning ----------------------------------------------------------------------------------------------------

#: Patterns by their number: one with seven vertices, and one with a few matches at every scale.
BIG, SMALL = 8, 6
ROUNDS = 9


def lcc_sql(rounds: int = ROUNDS, edges: str = "simple", directed: bool = False, graph: str = _DOMAIN) -> str:
    """The candidates of all patterns after so many rounds of counting neighbour labels."""
    both = "SELECT query_no, a AS u, b AS w FROM pattern_e" + ("" if directed else " UNION ALL SELECT query_no, b, a FROM pattern_e")
    parts_ = [
        graph,
        f"pe AS MATERIALIZED ({both})",
        "need AS MATERIALIZED (SELECT query_no, pe.u, v.label, count(*) AS k FROM pe JOIN pattern_v v USING (query_no) WHERE v.u = pe.w GROUP BY ALL)",
        "c0 AS MATERIALIZED (SELECT query_no, id AS v, u FROM vertices JOIN pattern_v USING (label))",
    ]
    for i in range(1, rounds + 1):
        parts_.append(f"a{i} AS MATERIALIZED (SELECT DISTINCT query_no, v FROM c{i - 1})")
        parts_.append(f"""n{i} AS MATERIALIZED (SELECT a.query_no, a.v, x.label, count(*) AS k FROM {edges} e JOIN a{i} a ON a.v = e.src
  JOIN a{i} b ON b.v = e.dst AND b.query_no = a.query_no JOIN vertices x ON x.id = e.dst GROUP BY ALL)""")
        parts_.append(f"""c{i} AS MATERIALIZED (SELECT c.query_no, c.v, c.u FROM c{i - 1} c LEFT JOIN need ON need.query_no = c.query_no AND need.u = c.u
  LEFT JOIN n{i} n ON n.query_no = c.query_no AND n.v = c.v AND n.label = need.label
  GROUP BY ALL HAVING count(*) FILTER (need.k > coalesce(n.k, 0)) = 0)""")
    return "WITH " + ",\n".join(parts_)


_LAST = f"c{ROUNDS}"
_LIVE_EDGES = f"l AS MATERIALIZED (SELECT DISTINCT query_no, v FROM {_LAST}), le AS MATERIALIZED (SELECT a.query_no, src, dst FROM simple JOIN l a ON a.v = src JOIN l b ON b.v = dst AND b.query_no = a.query_no)"


def _candidates(spark: SparkSession, d: str, **how) -> tuple[DataFrame, DataFrame]:
    cand, edges, _ = prune.prune_by_labels(domain(spark, d), given(spark, d), **how)
    return cand.withColumnRenamed("q", "query_no"), edges.withColumnRenamed("q", "query_no")


@query(lcc_sql() + f" SELECT query_no, v, u FROM {_LAST}")
def lcc_candidates(spark, d):
    return _candidates(spark, d)[0]


@query(lcc_sql() + f" SELECT DISTINCT query_no, v AS id FROM {_LAST}")
def lcc_nlf_vertices(spark, d):
    return _candidates(spark, d)[0].select("query_no", F.col("v").alias("id")).distinct()


@query(lcc_sql(edges="edges") + f" SELECT query_no, v, u FROM {_LAST}")
def lcc_multigraph(spark, d):
    return _candidates(spark, d, multigraph=True)[0]


@query(lcc_sql(2) + " SELECT query_no, v, u FROM c2")
def lcc_two_rounds(spark, d):
    return _candidates(spark, d, max_rounds=2)[0]


_ARCS = f"""{_LINES}, simple AS MATERIALIZED (SELECT DISTINCT src, dst FROM lines WHERE src <> dst),
vertices AS MATERIALIZED (SELECT a AS id, arg_max(l, (set_at, l)) AS label FROM vertex_label WHERE a IS NOT NULL AND l IS NOT NULL AND gone_at IS NULL GROUP BY a)"""


@query(lcc_sql(directed=True, graph=_ARCS) + f" SELECT query_no, v, u FROM {_LAST}")
def lcc_directed(spark, d):
    g = domain(spark, d)
    cand, _, _ = prune.prune_by_labels(Graph(g.lines, g.vertices, undirected=False), given(spark, d, directed=True))
    return cand.withColumnRenamed("q", "query_no")


@query(lcc_sql() + f", {_LIVE_EDGES} SELECT query_no, src, dst FROM le SEMI JOIN (SELECT DISTINCT query_no AS q, x.label AS f, y.label AS t FROM pe JOIN pattern_v x USING (query_no) JOIN pattern_v y USING (query_no) WHERE x.u = pe.u AND y.u = pe.w) k "
       "ON k.q = query_no AND k.f = (SELECT label FROM vertices WHERE id = src) AND k.t = (SELECT label FROM vertices WHERE id = dst)")
def lcc_active_edges(spark, d):
    """The edges that pruning leaves: between live vertices, and with the labels of an edge of the query."""
    return _candidates(spark, d)[1]


@query(lcc_sql() + f" SELECT query_no, v AS id, label, bit_or(1::BIGINT << u) AS bits FROM {_LAST} JOIN vertices ON id = v GROUP BY query_no, v, label")
def lcc_bits(spark, d):
    cand, g = _candidates(spark, d)[0], domain(spark, d)
    bits = cand.groupBy("query_no", F.col("v").alias("id")).agg(bit_set(F.col("u")).alias("bits"))
    return bits.join(g.vertices, "id").select("query_no", "id", "label", "bits")


@query(lcc_sql() + f" SELECT query_no, v, u FROM {_LAST}")
def lcc_from_bits(spark, d):
    """The candidates again from their bits."""
    most = max(p.n for p in given(spark, d).values())
    bits = lcc_bits(spark, d)
    found = prune.candidates_of_bits(bits.select(F.struct("query_no", "id").alias("id"), "bits"), most)
    return found.select("v.query_no", F.col("v.id").alias("v"), "u")


@query(lcc_sql() + f", {_LIVE_EDGES} SELECT query_no, (SELECT count(DISTINCT v) FROM {_LAST} c WHERE c.query_no = le.query_no) AS vertices, count(*) AS edges FROM le GROUP BY query_no")
def lcc_size(spark, d):
    """Live vertices and the edges between them, per pattern that has any."""
    cand, simple = _candidates(spark, d)[0], domain(spark, d).simple
    live = cut(cand.select("query_no", F.col("v").alias("id")).distinct())
    edges = simple.join(live.withColumnRenamed("id", "src"), "src").join(live.withColumnRenamed("id", "dst"), ["query_no", "dst"]).groupBy("query_no").agg(F.count(F.lit(1)).alias("edges"))
    return live.groupBy("query_no").agg(F.count(F.lit(1)).alias("vertices")).join(edges, "query_no").select("query_no", "vertices", "edges")


def _arc_sql(rounds: int) -> str:
    sql = lcc_sql()
    for i in range(ROUNDS + 1, ROUNDS + rounds + 1):
        sql += f""",
r{i} AS MATERIALIZED (SELECT DISTINCT o.query_no, e.src AS v, o.u AS w FROM simple e JOIN c{i - 1} o ON o.v = e.dst),
c{i} AS MATERIALIZED (SELECT c.query_no, c.v, c.u FROM c{i - 1} c JOIN pe ON pe.query_no = c.query_no AND pe.u = c.u LEFT JOIN r{i} r ON r.query_no = c.query_no AND r.v = c.v AND r.w = pe.w
  GROUP BY ALL HAVING count(*) FILTER (r.v IS NULL) = 0)"""
    return sql + f" SELECT query_no, v, u FROM c{ROUNDS + rounds}"


@query(_arc_sql(6))
def lcc_arc(spark, d):
    ps = given(spark, d)
    cand, edges, _ = prune.prune_by_labels(domain(spark, d), ps)
    return prune.prune_by_candidates(edges, cand, ps).withColumnRenamed("q", "query_no")


def _walk_query(walk: Sequence[int], labels: Sequence[int]) -> str:
    seen, froms, where = [walk[0]], [f"vertices v{walk[0]}"], [f"v{walk[0]}.label = {labels[walk[0]]}"]
    for i, (a, b) in enumerate(zip(walk, walk[1:])):
        froms.append(f"JOIN simple e{i} ON e{i}.src = v{a}.id" + (f" AND e{i}.dst = v{b}.id" if b in seen else ""))
        if b not in seen:
            froms.append(f"JOIN vertices v{b} ON v{b}.id = e{i}.dst AND v{b}.label = {labels[b]}")
            where += [f"v{b}.id <> v{w}.id" for w in seen]
            seen.append(b)
    return f"WITH {_DOMAIN} SELECT DISTINCT v{walk[0]}.id AS v FROM {' '.join(froms)} WHERE {' AND '.join(where)}"


# The walks below are over patterns written here, with labels that are there at every scale.
DIAMOND = Pattern.of([733, 34, 845, 900], [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)])
PATH = Pattern.of([810, 733, 810], [(0, 1), (1, 2)])


def _walked(spark, d, p: Pattern, w: Walk) -> DataFrame:
    g = domain(spark, d)
    edges, cand = prune.labelled_edges(g, p).select("src", "dst"), prune.label_candidates(g.vertices, p)
    return prune.by_walk(edges, cand, w, p).where(F.col("u") == w.vertices[0]).select("v")


@query(_walk_query((0, 1, 2, 0), DIAMOND.labels))
def nlcc_cycle(spark, d):
    return _walked(spark, d, DIAMOND, Walk((0, 1, 2, 0), cyclic=True))


@query(_walk_query((0, 1, 2), PATH.labels))
def nlcc_path(spark, d):
    return _walked(spark, d, PATH, Walk((0, 1, 2), cyclic=False))


@query(f"""WITH {_DOMAIN} SELECT id AS v, 0 AS u FROM vertices WHERE label = {DIAMOND.labels[0]} EXCEPT SELECT v, 0 FROM ({_walk_query((0, 1, 2, 0), DIAMOND.labels)})""")
def nlcc_failing(spark, d):
    g = domain(spark, d)
    edges, cand = prune.labelled_edges(g, DIAMOND).select("src", "dst"), prune.label_candidates(g.vertices, DIAMOND)
    return prune.failing(edges, cand, Walk((0, 1, 2, 0), cyclic=True), DIAMOND)


# --- matching ---------------------------------------------------------------------------------------------------


def match_sql(graph: str, labels: Sequence[int | str | None], edges: Sequence[tuple[int, int]], n: int, more: str = "") -> str:
    """All matches of a pattern by joins of the edges that can stand for each of its edges, each vertex after one beside it."""
    near = {u: {b if a == u else a for a, b in edges if u in (a, b)} for u in range(n)}
    order = [0]
    while len(order) < n:
        order.append(next(u for u in range(n) if u not in order and near[u] & set(order)))
    tables = [graph]
    for u in range(n):
        tables.append(f"v{u} AS MATERIALIZED (SELECT id FROM vertices" + (f" WHERE label = {labels[u]})" if labels[u] is not None else ")"))
    froms, where, at = [], [], {0: f"e{order[1]}_0.src"}
    for i, u in enumerate(order[1:], 1):
        for k, w in enumerate(x for x in order[:i] if x in near[u]):
            tables.append(f"e{u}_{w} AS MATERIALIZED (SELECT src, dst FROM simple WHERE src IN (SELECT id FROM v{w}) AND dst IN (SELECT id FROM v{u}))")
            on = [f"e{u}_{w}.src = {at[w]}"] if i > 1 else []
            if k:
                on.append(f"e{u}_{w}.dst = {at[u]}")
            else:
                at[u] = f"e{u}_{w}.dst"
            froms.append(f"JOIN e{u}_{w} ON {' AND '.join(on)}" if on else f"e{u}_{w}")
        where += [f"{at[u]} <> {at[w]}" for w in order[:i] if w not in near[u]]
    columns = ", ".join(f"{at[u]} AS m{u}" for u in range(n))
    tests = " AND ".join(where) + (more.format(**{f"v{u}": at[u] for u in at}) if more else "")
    return f"WITH {', '.join(tables)} SELECT {columns} FROM {' '.join(froms)}" + (f" WHERE {tests}" if tests else "")


SHAPES: dict[str, Pattern] = {
    "edge": Pattern.of([0, 1], [(0, 1)]),
    "path3": Pattern.of([0, 1, 0], [(0, 1), (1, 2)]),
    "star": Pattern.of([2, 0, 1, 1], [(0, 1), (0, 2), (0, 3)]),
    "triangle": Pattern.of([None, None, None], [(0, 1), (1, 2), (0, 2)]),
    "cycle4": Pattern.of([0, 1, 0, 2], [(0, 1), (1, 2), (2, 3), (0, 3)]),
    "diamond": Pattern.of([0, 1, 2, 0], [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]),
    "tree4": Pattern.of([3, 4, 5, 4], [(0, 1), (1, 2), (1, 3)]),
}


#: Shapes on the domain graph, with its hub; the labels are there at every scale.
DOMAIN_SHAPES: dict[str, Pattern] = {
    "triangle": Pattern.of([None, None, None], [(0, 1), (1, 2), (0, 2)]),
    "diamond": Pattern.of([None, 733, 810, None], [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]),
    "path3": Pattern.of([733, None, 733], [(0, 1), (1, 2)]),
    "square": Pattern.of([733, None, 733, 810], [(0, 1), (1, 2), (2, 3), (0, 3)]),
    "star": Pattern.of([133, 733, 733, 810], [(0, 1), (0, 2), (0, 3)]),
}


def _shape(graph: Callable[[SparkSession, str], Graph], p: Pattern, **how):
    return lambda spark, d: matching.match(graph(spark, d), p, **how)


for _name, _p in SHAPES.items():
    QUERIES[f"match_{_name}"] = _shape(parts, _p)
    SQL[f"match_{_name}"] = match_sql(_PARTS, _p.labels, _p.edges, _p.n)
for _how, _options in {"walk": {"strategy": "walk"}, "intersect": {"strategy": "intersect"}, "vf3": {"order": "vf3", "pruning": False}}.items():
    QUERIES[f"match_diamond_{_how}"] = _shape(parts, SHAPES["diamond"], **_options)
    SQL[f"match_diamond_{_how}"] = SQL["match_diamond"]
QUERIES["match_induced_path3"] = _shape(parts, SHAPES["path3"], induced=True)
SQL["match_induced_path3"] = match_sql(_PARTS, SHAPES["path3"].labels, SHAPES["path3"].edges, 3, " AND NOT EXISTS (SELECT 1 FROM simple x WHERE x.src = {v0} AND x.dst = {v2})")
for _name, _p in DOMAIN_SHAPES.items():
    QUERIES[f"match_domain_{_name}"] = _shape(domain, _p)
    SQL[f"match_domain_{_name}"] = match_sql(_DOMAIN, _p.labels, _p.edges, _p.n)


# The SQL has the patterns' edges written out, its labels come from pattern_v; the query reads both tables.
GIVEN = {
    0: [(0, 1), (0, 2), (0, 3), (0, 4)],
    1: [(0, 1), (0, 4), (1, 2), (2, 3), (3, 4)],
    2: [(0, 1), (1, 2), (1, 4), (1, 6), (2, 3), (2, 4), (3, 5), (3, 6), (4, 6)],
    3: [(0, 1), (1, 2), (1, 3), (2, 4), (3, 5), (4, 6), (4, 7)],
    4: [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (3, 4)],
    5: [(0, 1), (0, 3), (1, 2), (2, 3)],
    6: [(0, 1), (0, 2), (1, 3)],
    7: [(0, 1), (0, 2), (0, 3), (2, 3)],
    8: [(0, 1), (1, 2), (1, 3), (1, 5), (1, 6), (2, 4)],
    9: [(0, 1), (1, 2), (1, 3)],
    10: [(0, 1), (0, 2), (0, 3), (0, 4), (1, 5), (2, 6), (5, 6)],
    11: [(0, 1), (0, 2), (0, 3), (0, 4), (2, 3)],
}


def _given_sql() -> str:
    """All matches of all patterns: for each the joins of its edges between the candidates that counting leaves."""
    tables, selects = [lcc_sql()], []
    most = 1 + max(x for edges in GIVEN.values() for e in edges for x in e)
    for q, edges in GIVEN.items():
        n = 1 + max(max(e) for e in edges)
        for u in range(n):
            tables.append(f"q{q}v{u} AS MATERIALIZED (SELECT v AS id FROM {_LAST} WHERE query_no = {q} AND u = {u})")
        froms, at, done = [], {}, []
        order = [0]
        while len(order) < n:
            order.append(next(w for w in range(n) if w not in order and any({w, x} == set(e) for e in edges for x in order)))
        tests = []
        for u in order:
            near = [w for w in done if (w, u) in edges or (u, w) in edges]
            if not near:
                froms.append(f"q{q}v{u} v{u}")
            else:
                e = f"q{q}e{near[0]}_{u}"
                tables.append(f"{e} AS MATERIALIZED (SELECT src, dst FROM simple WHERE src IN (SELECT id FROM q{q}v{near[0]}) AND dst IN (SELECT id FROM q{q}v{u}))")
                froms.append(f"JOIN {e} e{u} ON e{u}.src = {at[near[0]]}")
                for w in near[1:]:
                    froms.append(f"JOIN simple s{w}_{u} ON s{w}_{u}.src = {at[w]} AND s{w}_{u}.dst = e{u}.dst")
            at[u] = f"v{u}.id" if not near else f"e{u}.dst"
            tests += [f"{at[u]} <> {at[w]}" for w in done]
            done.append(u)
        columns = ", ".join(f"{at[u]} AS m{u}" if u < n else f"NULL::BIGINT AS m{u}" for u in range(most))
        selects.append(f"SELECT {q} AS query_no, {columns} FROM {' '.join(froms)} WHERE {' AND '.join(tests)}")
    return ", ".join(tables) + " " + " UNION ALL ".join(selects)


@query(_given_sql())
def match_given(spark, d):
    return matching.match_many(domain(spark, d), given(spark, d))


def _one(number: int):
    """A pattern alone, with walk constraints at its rarest labels."""
    def run(spark, d):
        g, p = domain(spark, d), given(spark, d)[number]
        return matching.match(g, p, walks=constraints.generate(p, counts=matching.label_counts_of(g, p)))

    return run


for _no in (0, 1, 6, 10):
    QUERIES[f"match_given{_no}"] = _one(_no)
    _n = 1 + max(max(e) for e in GIVEN[_no])
    SQL[f"match_given{_no}"] = f"WITH m AS ({SQL['match_given']}) SELECT {', '.join(f'm{u}' for u in range(_n))} FROM m WHERE query_no = {_no}"


@query(f"""WITH m AS ({SQL['match_diamond']}) SELECT u, v, count(*) AS n FROM (SELECT 0 AS u, m0 AS v FROM m UNION ALL SELECT 1, m1 FROM m
UNION ALL SELECT 2, m2 FROM m UNION ALL SELECT 3, m3 FROM m) GROUP BY u, v""")
def match_count_by_vertex(spark, d):
    return matching.matches_per_vertex(matching.match(parts(spark, d), SHAPES["diamond"]))


@query(" UNION ALL ".join(f"SELECT {i} AS prototype, m0, m1, m2, m3 FROM ({match_sql(_PARTS, q.labels, q.edges, q.n)})" for i, q in enumerate(SHAPES["diamond"].prototypes(1))))
def match_edit1(spark, d):
    return matching.match_edited(parts(spark, d), SHAPES["diamond"], 1)


@query(f"WITH m AS ({SQL['match_diamond']}), {_PARTS} SELECT (SELECT count(*) FROM m) AS matches, (SELECT count(*) FROM m) AS last_step, (SELECT count(*) FROM vertices) AS vertices, (SELECT count(*) FROM simple) AS edges, true AS fewer_live")
def match_report(spark, d):
    report: dict = {}
    p = SHAPES["diamond"]
    n = matching.match(parts(spark, d), p, report=report).count()
    last = report["states"][report["order"][-1]].get["rows"] * len(p.automorphisms())
    fewer = report["live_vertices"] <= report["vertices"] and report["live_edges"] <= report["edges"]
    return spark.createDataFrame([(n, last, report["vertices"], report["edges"], fewer)], "matches long, last_step long, vertices long, edges long, fewer_live boolean")


@query(f"""WITH {_DOMAIN}, deg AS (SELECT id, count(src) AS n FROM vertices LEFT JOIN edges ON src = id GROUP BY id),
pd AS (SELECT query_no, u, count(*) AS d FROM (SELECT query_no, a AS u FROM pattern_e UNION ALL SELECT query_no, b FROM pattern_e) GROUP BY ALL)
SELECT query_no, u, round((SELECT count(*) FROM vertices v WHERE v.label = pattern_v.label) / (SELECT count(*) FROM vertices)::DOUBLE * ((SELECT count(*) FROM deg WHERE n >= pd.d) / (SELECT count(*) FROM vertices)::DOUBLE), 12) AS probability
FROM pattern_v JOIN pd USING (query_no, u)""")
def label_tail_prob(spark, d):
    g = domain(spark, d)
    rows = [(q, u, round(float(x), 12)) for q, p in given(spark, d).items() for u, x in enumerate(matching.label_rarity(g, p))]
    return spark.createDataFrame(rows, "query_no int, u int, probability double")


# --- analytics --------------------------------------------------------------------------------------------------

_DOD = """deg AS MATERIALIZED (SELECT id, count(*) AS d FROM (SELECT a AS id FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY id),
dod AS MATERIALIZED (SELECT CASE WHEN (x.d, x.id) < (y.d, y.id) THEN a ELSE b END AS lo, CASE WHEN (x.d, x.id) < (y.d, y.id) THEN b ELSE a END AS hi
  FROM pairs JOIN deg x ON x.id = a JOIN deg y ON y.id = b),
tri AS MATERIALIZED (SELECT p.lo AS x, p.hi AS y, q.hi AS z FROM dod p JOIN dod q ON p.lo = q.lo AND p.hi < q.hi
  JOIN pairs r ON r.a = p.hi AND r.b = q.hi)"""
_SIDES = """sides AS MATERIALIZED (SELECT least(x, y) AS a, greatest(x, y) AS b FROM tri UNION ALL SELECT least(x, z), greatest(x, z) FROM tri
  UNION ALL SELECT y, z FROM tri),
per AS MATERIALIZED (SELECT pairs.a, pairs.b, count(sides.a) AS n FROM pairs LEFT JOIN sides ON sides.a = pairs.a AND sides.b = pairs.b GROUP BY ALL)"""


@query(f"WITH {_DOMAIN}, {_DOD} SELECT lo, hi FROM dod")
def dod_edges(spark, d):
    return dense.oriented(domain(spark, d).pairs)


@query(f"WITH {_DOMAIN}, {_DOD} SELECT (SELECT sum(n * (n - 1) // 2)::BIGINT FROM (SELECT count(*) AS n FROM dod JOIN deg w ON w.id = lo JOIN deg t ON t.id = hi WHERE w.d > 1 AND t.d > 1 GROUP BY lo)) AS wedges, (SELECT count(*) FROM tri) AS triangles")
def triangle_count(spark, d):
    return dense.triangle_count(domain(spark, d))


@query(f"WITH {_DOMAIN}, {_DOD} SELECT sum(n * (n - 1) // 2)::BIGINT AS wedges FROM (SELECT count(*) AS n FROM dod GROUP BY lo)")
def wedge_count(spark, d):
    out = dense.oriented(domain(spark, d).pairs).groupBy("lo").agg(F.count(F.lit(1)).alias("n"))
    return out.agg(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")).alias("wedges"))


@query(f"WITH {_DOMAIN}, {_DOD}, {_SIDES} SELECT a, b, n FROM per")
def triangle_per_edge(spark, d):
    return dense.edge_triangles(domain(spark, d).pairs)


@query(f"""WITH {_DOMAIN}, {_DOD}, {_SIDES} SELECT count(*) AS pairs, (sum(n) // 3)::BIGINT AS triangles, count(*) FILTER (n > 0) AS closing_edges,
max(n) AS max_per_edge, count(*) FILTER (n > 0) / count(*)::DOUBLE AS closing_share FROM per""")
def triangle_stats(spark, d):
    return dense.triangle_statistics(domain(spark, d))


def _cc_sql(edges: str, last: str, rounds: int = 12) -> str:
    out = [_DOMAIN, f"e AS MATERIALIZED ({edges})", "l0 AS MATERIALIZED (SELECT DISTINCT src AS id, src AS cc FROM edges)"]
    for i in range(1, rounds + 1):
        out.append(f"""l{i} AS MATERIALIZED (SELECT l.id, least(l.cc, min(o.cc)) AS cc FROM l{i - 1} l LEFT JOIN e ON e.src = l.id
  LEFT JOIN l{i - 1} o ON o.id = e.dst GROUP BY l.id, l.cc)""")
    return "WITH " + ",\n".join(out) + " " + last.format(f"l{rounds}")


@query(_cc_sql("SELECT src, dst FROM simple", "SELECT id, cc FROM {}"))
def cc(spark, d):
    return traverse.components(domain(spark, d))


@query(_cc_sql("SELECT src, dst FROM simple", "SELECT cc, count(*) AS n FROM {} GROUP BY cc"))
def cc_sizes(spark, d):
    return traverse.component_sizes(traverse.components(domain(spark, d)))


@query(_cc_sql("SELECT src, dst FROM simple", "SELECT cc, count(*) AS n FROM {} GROUP BY cc ORDER BY cc LIMIT 2"))
def cc_first(spark, d):
    return traverse.component_sizes(traverse.components(domain(spark, d))).orderBy("cc").limit(2)


@query(_cc_sql("SELECT DISTINCT src, dst FROM edges WHERE weight <= 0.2 AND src <> dst", "SELECT id, cc FROM {}", 40))
def cc_weight_filtered(spark, d):
    return traverse.components(domain(spark, d), edge=F.col("weight") <= 0.2)


@query(_cc_sql("SELECT src, dst FROM simple JOIN vertices a ON a.id = src JOIN vertices b ON b.id = dst WHERE a.label % 2 = 0 AND b.label % 2 = 0",
               "SELECT x.id, cc FROM {} x JOIN vertices v ON v.id = x.id WHERE v.label % 2 = 0", 20))
def cc_vertex_filtered(spark, d):
    return traverse.components(domain(spark, d), vertex=F.col("label") % 2 == 0)


SOURCE = 1000


def _bfs_sql(last: str, rounds: int = 10) -> str:
    out = [_DOMAIN, f"f0 AS MATERIALIZED (SELECT min(src) AS id, 0 AS level, min(src) AS parent FROM edges WHERE src >= {SOURCE})", "k0 AS MATERIALIZED (SELECT * FROM f0)"]
    for i in range(1, rounds + 1):
        out.append(f"f{i} AS MATERIALIZED (SELECT e.dst AS id, {i} AS level, min(e.src) AS parent FROM simple e JOIN f{i - 1} f ON f.id = e.src WHERE e.dst NOT IN (SELECT id FROM k{i - 1}) GROUP BY e.dst)")
        out.append(f"k{i} AS MATERIALIZED (SELECT * FROM k{i - 1} UNION ALL SELECT * FROM f{i})")
    return "WITH " + ",\n".join(out) + " " + last.format(f"k{rounds}")


@query(_bfs_sql("SELECT id, level, parent FROM {}"))
def bfs_levels(spark, d):
    return traverse.bfs(domain(spark, d), SOURCE)


@query(_bfs_sql("SELECT level, count(*) AS n FROM {} GROUP BY level"))
def bfs_level_counts(spark, d):
    return traverse.bfs(domain(spark, d), SOURCE).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def _sssp_sql(rounds: int = 30) -> str:
    out = [_DOMAIN, "w AS MATERIALIZED (SELECT src, dst, min(weight) AS weight FROM edges WHERE weight IS NOT NULL AND src <> dst GROUP BY src, dst)", f"d0 AS MATERIALIZED (SELECT min(src) AS id, 0.0::DOUBLE AS distance FROM w WHERE src >= {SOURCE})"]
    for i in range(1, rounds + 1):
        out.append(f"""d{i} AS MATERIALIZED (SELECT id, min(distance) AS distance FROM (SELECT * FROM d{i - 1}
  UNION ALL SELECT w.dst, d.distance + w.weight FROM w JOIN d{i - 1} d ON d.id = w.src) GROUP BY id)""")
    return "WITH " + ",\n".join(out) + f" SELECT id, round(distance, 9) AS distance FROM d{rounds}"


@query(_sssp_sql())
def sssp(spark, d):
    return traverse.sssp(domain(spark, d), SOURCE).select("id", F.round("distance", 9).alias("distance"))


def _pagerank_sql(rounds: int, damping: float | None) -> str:
    out = [_DOMAIN, "deg AS MATERIALIZED (SELECT src, count(*) AS n FROM edges GROUP BY src)", "ids AS MATERIALIZED (SELECT id FROM vertices UNION SELECT src FROM edges)",
           "size AS (SELECT count(*)::DOUBLE AS n FROM ids)", "r0 AS MATERIALIZED (SELECT id, 1 / size.n AS rank FROM ids, size)"]
    for i in range(1, rounds + 1):
        into = "coalesce(sum(r.rank / deg.n), 0.0)"
        into = into if damping is None else f"(1 - {damping}) / max(size.n) + {damping} * {into}"
        out.append(f"r{i} AS MATERIALIZED (SELECT v.id, {into} AS rank FROM ids v CROSS JOIN size LEFT JOIN edges e ON e.dst = v.id LEFT JOIN r{i - 1} r ON r.id = e.src LEFT JOIN deg ON deg.src = e.src AND r.id IS NOT NULL GROUP BY v.id)")
    return "WITH " + ",\n".join(out) + f" SELECT id, round(rank, 9) AS rank FROM r{rounds}"


@query(_pagerank_sql(1, None))
def pagerank_1(spark, d):
    return traverse.pagerank(domain(spark, d)).select("id", F.round("rank", 9).alias("rank"))


@query(_pagerank_sql(1, None).replace("SELECT count(*)::DOUBLE AS n FROM ids", "SELECT max(id)::DOUBLE AS n FROM ids").replace("round(rank, 9)", "round(rank, 12)"))
def pagerank_max_id(spark, d):
    return traverse.pagerank(domain(spark, d), normalizer="max_id").select("id", F.round("rank", 12).alias("rank"))


@query(_pagerank_sql(5, 0.85))
def pagerank_n(spark, d):
    return traverse.pagerank(domain(spark, d), 5, 0.85).select("id", F.round("rank", 9).alias("rank"))


CORE, TRUSS = 12, 8


def _core_sql(k: int, rounds: int) -> str:
    out = [_DOMAIN, "e0 AS MATERIALIZED (SELECT src, dst FROM simple)"]
    for i in range(1, rounds + 1):
        out.append(f"g{i} AS MATERIALIZED (SELECT src FROM e{i - 1} GROUP BY src HAVING count(*) >= {k})")
        out.append(f"e{i} AS MATERIALIZED (SELECT src, dst FROM e{i - 1} WHERE src IN (SELECT src FROM g{i}) AND dst IN (SELECT src FROM g{i}))")
    return "WITH " + ",\n".join(out) + f" SELECT src AS id, count(*) AS d FROM e{rounds} GROUP BY src"


@query(_core_sql(CORE, 30))
def kcore_k(spark, d):
    return dense.core_vertices(domain(spark, d), CORE)


def _truss_sql(k: int, rounds: int) -> str:
    out = [_DOMAIN, "t0 AS MATERIALIZED (SELECT src, dst FROM simple)"]
    for i in range(1, rounds + 1):
        out.append(f"""t{i} AS MATERIALIZED (SELECT x.src, x.dst, count(*) AS n FROM t{i - 1} x JOIN t{i - 1} y ON y.src = x.src JOIN t{i - 1} z ON z.src = y.dst AND z.dst = x.dst
  GROUP BY x.src, x.dst HAVING count(*) >= {k - 2})""")
    return "WITH " + ",\n".join(out) + f" SELECT src AS a, dst AS b, n FROM t{rounds} WHERE src < dst"


@query(_truss_sql(TRUSS, 12))
def ktruss_k(spark, d):
    return dense.truss(domain(spark, d).pairs, TRUSS)


def _truss_levels_sql(last: int, rounds: int) -> str:
    out, rows, before = [_DOMAIN, "t AS MATERIALIZED (SELECT src, dst, 1 AS n FROM simple)"], [], "t"
    for k in range(3, last + 1):
        for i in range(1, rounds + 1):
            now = f"t{k}_{i}"
            out.append(f"""{now} AS MATERIALIZED (SELECT x.src, x.dst, count(*) AS n FROM {before} x JOIN {before} y ON y.src = x.src JOIN {before} z ON z.src = y.dst AND z.dst = x.dst
  GROUP BY x.src, x.dst HAVING count(*) >= {k - 2})""")
            before = now
        out.append(f"d{k} AS MATERIALIZED (SELECT src, count(*) AS d FROM {before} GROUP BY src)")
        rows.append(f"""SELECT {k} AS k, (SELECT count(*) FROM {before}) // 2 AS edges, (SELECT count(*) FROM d{k}) AS vertices, (SELECT coalesce(sum(n), 0) FROM {before})::BIGINT // 6 AS triangles,
(SELECT count(DISTINCT CASE WHEN (x.d, x.src) < (y.d, y.src) THEN x.src ELSE y.src END) FROM {before} e JOIN d{k} x ON x.src = e.src JOIN d{k} y ON y.src = e.dst) AS dod_sources""")
    all_ = " UNION ALL ".join(rows)
    return "WITH " + ",\n".join(out) + f", r AS (SELECT *, lag(edges) OVER (ORDER BY k) AS before FROM ({all_})) SELECT k, edges, vertices, triangles, dod_sources FROM r WHERE edges > 0 OR before > 0 OR k = 3"


@query(_truss_levels_sql(12, 9))
def ktruss_levels(spark, d):
    return dense.truss_levels(domain(spark, d))


# --- generators, samples, the learned filter ------------------------------------------------------------------------


@query("""WITH l AS (SELECT query_no * 8 + a AS src, query_no * 8 + b AS dst, a + b + 1 AS weight FROM pattern_e),
r AS (SELECT a AS src, b AS dst, 1 + a AS weight FROM pattern_e WHERE query_no = 0)
SELECT (l.src * 8 + r.src)::BIGINT AS src, (l.dst * 8 + r.dst)::BIGINT AS dst, (l.weight * r.weight)::BIGINT AS weight FROM l CROSS JOIN r""")
def kronecker_small(spark, d):
    e = table(spark, d, "pattern_e")
    left = e.select((F.col("query_no") * 8 + F.col("a")).cast("long").alias("src"), (F.col("query_no") * 8 + F.col("b")).cast("long").alias("dst"), (F.col("a") + F.col("b") + 1).cast("long").alias("weight"))
    right = e.where("query_no = 0").select(F.col("a").cast("long").alias("src"), F.col("b").cast("long").alias("dst"), (F.col("a") + 1).cast("long").alias("weight"))
    return generate.kronecker(left, right, 8)


@query("WITH RECURSIVE j AS (SELECT 0 AS dst UNION ALL SELECT dst + 1 FROM j WHERE dst < 99), t AS (SELECT i.dst AS src, j.dst FROM j i JOIN j ON i.dst <= j.dst) SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM t WHERE dst * (dst + 1) // 2 + src < 5000")
def upper_triangle(spark, d):
    return generate.upper_triangle(spark, 5000)


@query("SELECT 2097152::BIGINT AS edges, 0::BIGINT AS out_of_range, true AS skewed, true AS scrambled")
def rmat_checks(spark, d):
    """The defaults: 17 bits, 16 edges a vertex. Before scrambling most edges have ends in the lower half, after it not."""
    e, plain = generate.rmat(spark, 17, 16 << 17), generate.rmat(spark, 17, 16 << 17, scramble=False)
    outside = F.count(F.when((F.least("src", "dst") < 0) | (F.greatest("src", "dst") >= 1 << 17), 1))
    low = F.count(F.when(F.col("src") < 1 << 16, 1)) / F.count(F.lit(1))
    a, b = e.agg(F.count(F.lit(1)).alias("edges"), outside.alias("out_of_range"), low.alias("low")), plain.agg(low.alias("low")).first()
    most = e.groupBy("src").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return a.select("edges", "out_of_range", F.lit(most > 1000 and b.low > 0.7).alias("skewed"), (F.col("low") < 0.9).alias("scrambled"))


@query("SELECT 2097152::BIGINT AS pairs, 2097152::BIGINT AS distinct_pairs, 0::BIGINT AS not_ordered")
def rmat_unique_checks(spark, d):
    pairs = cut(generate.rmat_unique(spark, 17))
    n = pairs.distinct().count()
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.lit(n).cast("long").alias("distinct_pairs"), F.count(F.when(F.col("a") >= F.col("b"), 1)).alias("not_ordered"))


@query("SELECT r AS rewired, 400000::BIGINT AS edges, 100000::BIGINT AS sources, 0::BIGINT AS bad, true AS preferred FROM (VALUES (false), (true)) t(r)")
def preferential_checks(spark, d):
    """Every vertex sends four edges; without rewiring all go to older ones, and a few get many."""
    parts_ = []
    for r in (False, True):
        e = cut(generate.preferential(spark, 100_000, 4, rewire=r))
        most = e.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        fours = e.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where("n = 4").count()
        bad = F.count(F.when((F.col("dst") < 0) | (F.col("dst") >= 100_000) | (F.lit(not r) & (F.col("dst") > F.col("src"))), 1))
        parts_.append(e.agg(F.lit(r).alias("rewired"), F.count(F.lit(1)).alias("edges"), F.lit(fours).cast("long").alias("sources"), bad.alias("bad"), F.lit(most > 100).alias("preferred")))
    return parts_[0].unionByName(parts_[1])


@query("SELECT 50::BIGINT AS vertices, 0::BIGINT AS lost, 0::BIGINT AS made_up, 1::BIGINT AS components")
def sample_walk_checks(spark, d):
    """Fifty vertices of a walk, with exactly the edges that the graph has between them."""
    g = parts(spark, d)
    v, e = sample.sample_subgraph(g, 50)
    v, e = cut(v), cut(e)
    all_ = g.induced(v).select("src", "dst").distinct()
    row = (v.count(), all_.join(e, ["src", "dst"], "left_anti").count(), e.join(all_, ["src", "dst"], "left_anti").count(), traverse.components(Graph(e)).select("cc").distinct().count())
    return spark.createDataFrame([row], "vertices long, lost long, made_up long, components long")


@query("SELECT kind, 5 AS vertices, true AS connected, true AS found FROM (VALUES ('path'), ('tree'), ('other'), ('cycle')) t(kind)")
def sample_query_checks(spark, d):
    """A query of each kind drawn from the graph is in it."""
    g = parts(spark, d)
    g, rows = Graph(stored(g.lines), g.vertices, once=True), []
    simple = sample.turned_edges(g)
    for kind in ("path", "tree", "other", "cycle"):
        p, walked = sample.drawn(g, 5, kind, seed=3, constrained=False, simple=simple)
        rows.append((kind, p.n, p.connected(), matching.is_in(g, p, walked, simple)))
    return spark.createDataFrame(rows, "kind string, vertices int, connected boolean, found boolean")


# --- readers and sinks: written as text, read again -------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/text-{uuid.uuid4()}"


@query(f"WITH {_LINES} SELECT src, dst, coalesce(weight, 0.0) AS weight, CASE WHEN src < 0 OR dst < 0 THEN 'id' END AS reason FROM lines")
def text_edges(spark, d):
    """Every line with the reason for which it is no edge, if there is one."""
    at = _folder(spark)
    text.write_lines(domain(spark, d).lines.select("src", "dst", F.coalesce("weight", F.lit(0.0)).alias("weight")), at)
    return text.edge_lines(spark.read.text(at), weighted=True).drop("value")


@query(f"WITH {_DOMAIN} SELECT src, dst FROM simple WHERE src >= 0 AND dst >= 0")
def text_both_ways(spark, d):
    """Edges with a negative id can't be read; there are such in the table."""
    at = _folder(spark)
    text.write_lines(generate.both_ways(domain(spark, d).pairs.where("a >= 0")), at)
    return text.read_edges(spark, at).drop("weight")


@query(f"WITH {_DOMAIN} SELECT id, label FROM vertices")
def text_labels(spark, d):
    """By a list that names a folder and a pattern; the first name isn't there and is looked up beside the list."""
    at = _folder(spark)
    v = domain(spark, d).vertices
    text.write_lines(v.where("id % 2 = 0"), f"{at}/even", "id", "label")
    text.write_lines(v.where("id % 2 <> 0"), f"{at}/odd", "id", "label")
    spark.createDataFrame([("/elsewhere/even",), (f"{at}/odd",)], "value string").coalesce(1).write.text(f"{at}/list")
    return text.read_label_list(spark, f"{at}/list")


@query(SQL["match_domain_star"])
def text_matches(spark, d):
    at = _folder(spark)
    text.write_matches(matching.match(domain(spark, d), DOMAIN_SHAPES["star"]), at)
    f = F.split("value", " ")
    return spark.read.text(at).select(*(f[u].cast("long").alias(f"m{u}") for u in range(4)))


@query(f"SELECT concat_ws(', ', m0, m1, m0, m2, m0, m3) AS walk FROM ({SQL['match_domain_star']})")
def text_walks(spark, d):
    at, p = _folder(spark), DOMAIN_SHAPES["star"]
    text.write_walks(matching.match(domain(spark, d), p, strategy="walk"), p.covering_walk(0), at)
    return spark.read.text(at).withColumnRenamed("value", "walk")


@query(lcc_sql() + f" SELECT v AS id, label, bit_or(1::BIGINT << u) AS bits FROM {_LAST} JOIN vertices ON id = v WHERE query_no = {SMALL} GROUP BY v, label")
def text_pruned(spark, d):
    at, g = _folder(spark), domain(spark, d)
    cand, edges, _ = prune.by_neighbour_labels(g, given(spark, d)[SMALL])
    text.pruned_lines(prune.candidate_bits(cand, g.vertices), edges).write.text(at)
    return text.read_pruned(spark, at)[0]


@query(f"SELECT a::BIGINT AS src, b::BIGINT AS dst, (a + b)::BIGINT AS weight FROM pattern_e WHERE query_no = {BIG} UNION ALL SELECT b, a, a + b FROM pattern_e WHERE query_no = {BIG}")
def text_factor(spark, d):
    at = _folder(spark)
    e = table(spark, d, "pattern_e").where(F.col("query_no") == BIG).select(F.lit(1).alias("o"), F.concat_ws(" ", "a", "b", F.col("a") + F.col("b")).alias("value"))
    head = spark.createDataFrame([(0, str(given(spark, d)[BIG].n))], "o int, value string")
    head.unionByName(e).coalesce(1).sortWithinPartitions("o").select("value").write.text(at)
    return text.read_factor(spark, at)[1]


@query("SELECT query_no, a, b, x.label AS label_a, y.label AS label_b FROM pattern_e JOIN pattern_v x USING (query_no) JOIN pattern_v y USING (query_no) WHERE x.u = a AND y.u = b")
def text_patterns(spark, d):
    """Every pattern written with all its walk constraints and read again, from one text and from a folder of files."""
    rows = []
    for q, p in given(spark, d).items():
        walks = constraints.generate(p, "all")
        read = read_pattern(write_pattern(p, q, walks).splitlines())
        assert [Walk.read(c).vertices for c in read.constraints] == [w.vertices for w in walks]
        with tempfile.TemporaryDirectory() as folder:  # the driver's own, for a query of a few lines
            write_pattern_files(read, folder)
            read = read_pattern_files(folder)
        rows += [(q, a, b, read.labels[a], read.labels[b]) for a, b in read.edges]
    return spark.createDataFrame(rows, "query_no int, a int, b int, label_a long, label_b long")


@query("""WITH RECURSIVE e AS (SELECT query_no, a, b FROM pattern_e UNION ALL SELECT query_no, b, a FROM pattern_e),
p AS (SELECT query_no, a AS first, b AS last, [a, b] AS path FROM e WHERE b > a UNION ALL
  SELECT p.query_no, first, e.b, list_append(path, e.b) FROM p JOIN e ON e.query_no = p.query_no AND e.a = p.last WHERE e.b > first AND NOT list_contains(path, e.b))
SELECT p.query_no, len(path)::INTEGER AS length, count(*) AS n FROM p JOIN e ON e.query_no = p.query_no AND e.a = last AND e.b = first WHERE len(path) > 2 AND path[2] < last GROUP BY ALL""")
def pattern_cycles(spark, d):
    rows = [(q, len(c)) for q, p in given(spark, d).items() for c in p.cycles()]
    return spark.createDataFrame(rows, "query_no int, length int").groupBy("query_no", "length").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_DOMAIN} SELECT src, dst, weight FROM edges")
def store_round_trip(spark, d):
    """Saved, copied, loaded."""
    at = _folder(spark)
    domain(spark, d).save(f"{at}/a")
    Graph.copy(spark, f"{at}/a", f"{at}/b")
    Graph.remove(spark, f"{at}/a")
    return Graph.load(spark, f"{at}/b").edges


# --- the learned filter -----------------------------------------------------------------------------------------


def _kept_sql(number: int) -> str:
    """le: the edges that pruning leaves for a pattern; h0, h1, h2, h3: neighbourhoods of its candidates on them."""
    out = [lcc_sql(), f"c AS MATERIALIZED (SELECT v, u FROM {_LAST} WHERE query_no = {number})", "l AS MATERIALIZED (SELECT DISTINCT v, label FROM c JOIN vertices ON id = v)",
           f"k AS MATERIALIZED (SELECT DISTINCT x.label AS f, y.label AS t FROM pe JOIN pattern_v x USING (query_no) JOIN pattern_v y USING (query_no) WHERE x.u = pe.u AND y.u = pe.w AND query_no = {number})",
           "le AS MATERIALIZED (SELECT src, dst FROM simple JOIN l a ON a.v = src JOIN l b ON b.v = dst SEMI JOIN k ON k.f = a.label AND k.t = b.label)",
           "h0 AS MATERIALIZED (SELECT DISTINCT v, v AS id, 0 AS hop FROM c)"]
    for h in (1, 2, 3):
        out.append(f"""h{h} AS MATERIALIZED (SELECT v, id, min(hop) AS hop FROM (SELECT * FROM h{h - 1} UNION ALL SELECT n.v, e.dst, {h} FROM h{h - 1} n JOIN le e ON e.src = n.id) GROUP BY v, id)""")
    return ", ".join(out)


def _ego(spark: SparkSession, d: str, number: int) -> tuple[DataFrame, DataFrame]:
    """The edges that pruning leaves for a pattern, and its candidates, which are the centres."""
    cand, edges, _ = prune.prune(domain(spark, d), given(spark, d)[number])
    return edges, cand.select("v").distinct()


@query(_kept_sql(BIG) + " SELECT v, id, hop FROM h3")
def ego_network(spark, d):
    """Three hops around every candidate of a pattern, on the edges that its pruning leaves."""
    return learned.ego_nodes(*_ego(spark, d, BIG))


@query(_kept_sql(BIG) + " SELECT a.v, src, dst FROM le JOIN h3 a ON a.id = src JOIN h3 b ON b.id = dst AND b.v = a.v")
def ego_edges(spark, d):
    return learned.edges_around(*_ego(spark, d, BIG))


@query(_kept_sql(SMALL) + f""", w AS (SELECT DISTINCT label FROM pattern_v WHERE query_no = {SMALL}),
has AS (SELECT h3.v, count(DISTINCT x.label) AS k FROM h3 JOIN vertices x ON x.id = h3.id JOIN w ON w.label = x.label GROUP BY h3.v)
SELECT c.v, c.u FROM c JOIN has ON has.v = c.v WHERE has.k = (SELECT count(*) FROM w)""")
def learned_filter(spark, d):
    """Candidates by a score over their neighbourhoods; here whether these have all labels of the pattern."""
    g, p = domain(spark, d), given(spark, d)[SMALL]
    cand, edges, _ = prune.prune(g, p)
    return learned.learned_candidates(edges, g.vertices, cand, p, _has_labels)


def _has_labels(nodes, edges, p: Pattern, u: int) -> float:
    return float(set(p.labels) <= set(nodes["label"]))


@query(f"""WITH {_DOMAIN}, c AS (SELECT id FROM vertices WHERE label = 496) SELECT (SELECT count(*) FROM c) AS sets, 0::BIGINT AS wrong_size, 0::BIGINT AS apart,
(SELECT count(*) FROM c) AS positives, 0::BIGINT AS same_label""")
def learned_samples(spark, d):
    """Node sets grown around the vertices of one label, and a negative vertex for each."""
    g = domain(spark, d)
    e, c = g.simple, cut(g.vertices.where("label = 496").select(F.col("id").alias("v")))
    sets = cut(learned.grown_samples(e, c))
    of = sets.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("full").alias("full"))
    both = sets.select("v", F.col("id").alias("src")).join(sets.select("v", F.col("id").alias("dst")), "v").where("src <> dst")
    near = both.join(g.edges, ["src", "dst"], "left_semi").select("v", F.col("src").alias("id")).distinct()
    lonely = sets.join(near, ["v", "id"], "left_anti").join(of, "v").where("n > 1").count()
    pairs = learned.with_negatives(c, g.vertices).join(g.vertices.withColumnRenamed("id", "other"), "other")
    same = pairs.where("NOT positive AND label = 496").count()
    row = (of.count(), of.where("full AND (n < 3 OR n > 29)").count(), lonely, pairs.where("positive").count(), same)
    return spark.createDataFrame([row], "sets long, wrong_size long, apart long, positives long, same_label long")


@query("""WITH s AS (SELECT weight AS score, s < t AS pos FROM edge_list WHERE weight IS NOT NULL AND s IS NOT NULL AND t IS NOT NULL),
g AS (SELECT score, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS q FROM s GROUP BY score),
c AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(q) OVER (ORDER BY score DESC) AS fp FROM g), t AS (SELECT sum(p)::DOUBLE AS p, sum(q)::DOUBLE AS q FROM g)
SELECT round(sum(c.q * (tp - c.p / 2)) / max(t.p * t.q), 9) AS auroc, round(sum(c.p * tp / (tp + fp)) / max(t.p), 9) AS average_precision FROM c, t""")
def ranking(spark, d):
    lines = domain(spark, d).lines.where("weight IS NOT NULL")
    found = learned.ranking_quality(lines.select(F.col("weight").alias("score"), (F.col("src") < F.col("dst")).alias("positive")))
    return found.select(F.round("auroc", 9).alias("auroc"), F.round("average_precision", 9).alias("average_precision"))


@query(f"""WITH m AS MATERIALIZED (SELECT * FROM ({SQL['match_given']}) WHERE query_no = {SMALL}), t AS MATERIALIZED (SELECT m0 AS v, 0 AS u FROM m UNION SELECT m1, 1 FROM m UNION SELECT m2, 2 FROM m UNION SELECT m3, 3 FROM m),
{_DOMAIN}, c AS MATERIALIZED (SELECT id AS v, u FROM vertices JOIN pattern_v USING (label) WHERE query_no = {SMALL})
SELECT (SELECT count(*) FROM t) AS tp, (SELECT count(*) FROM c) - (SELECT count(*) FROM t) AS fp""")
def label_filter_quality(spark, d):
    g, p = domain(spark, d), given(spark, d)[SMALL]
    cand = prune.label_candidates(g.vertices, p)
    return learned.evaluation(cand, learned.true_candidates(matching.match(g, p)), cand).select("tp", "fp")
