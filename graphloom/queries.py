"""The queries of the library, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from graphloom.functions import arrays
from graphloom.operators import app, cliques, cluster, core, graph, match, quasi, sets, skew
from graphloom.plans.matchplan import filter_order, match_sql, tree
from graphloom.plans.pattern import Pattern, preset, preset_numbers
from graphloom.sources import lines
from graphloom import roundtrips
from graphloom.tables import load, written

Query = Callable[[SparkSession, str], DataFrame]


def parts_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that were returned from the same order, as normalised edges."""
    return graph.copurchase(load(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_returnflag"), F.col("l_returnflag") == "R")


def large_orders_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts ordered together in quantities of 40 and more, as normalised edges."""
    return graph.copurchase(load(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity"), F.col("l_quantity") >= 40)


def noted_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge records as normalised edges."""
    return graph.edges_norm(load(spark, sf_dir, "edges", "src", "dst"))


def order_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each order that were returned, as sets."""
    x = load(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_returnflag").where(F.col("l_returnflag") == "R")
    return x.groupBy(F.col("l_orderkey").alias("set_id")).agg(F.collect_list("l_partkey").alias("members"))


def kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three-vertex cliques of the graph of large orders, as kernels."""
    found = match.prefix_rows(large_orders_graph(spark, sf_dir), preset(23))
    return found.select(F.xxhash64("q0", "q1", "q2").alias("kernel_id"), F.array("q0", "q1", "q2").alias("members"))


def with_label(edges: DataFrame, labels: int = 4) -> DataFrame:
    """``(v, label)`` of the ends of ``edges``, the label being the rest of v by ``labels``."""
    return graph.degrees(edges).select("v", (F.col("v") % labels).cast("int").alias("label"))


def list_sizes(edges: DataFrame) -> DataFrame:
    """``(src, dst, common, only_src, probed, within)``: of each edge what the neighbour lists of its ends share, by the functions on lists."""
    adj = graph.adjacency(edges)
    a, b = F.col("_a"), F.col("_b")
    both = edges.join(adj.select(F.col("v").alias("src"), F.col("nbrs").alias("_a")), "src").join(adj.select(F.col("v").alias("dst"), F.col("nbrs").alias("_b")), "dst")
    found = {"common": arrays.intersection_size(a, b), "only_src": F.size(arrays.difference(a, b)).cast("bigint"), "probed": F.size(arrays.probed(a, b)).cast("bigint")}
    return both.select("src", "dst", *(c.alias(name) for name, c in found.items()), arrays.is_subset(arrays.difference(a, F.array("dst")), b).alias("within"))


def kmeans_report(edges: DataFrame) -> DataFrame:
    """``(vertices, few, sound)`` of the clusters in two levels of two: whether there are at most four, and similarities are from 0 to 1."""
    per = cluster.cluster_statistics(cluster.kmeans(edges, "2x2", 5))
    sound = F.min((F.col("vertices") > 0) & (F.col("sum_sim") >= 0) & (F.col("avg_sim") <= 1 + 1e-9))
    return per.agg(F.sum("vertices").alias("vertices"), (F.count("*") <= 4).alias("few"), sound.alias("sound"))


def _candidate_edges(edges: DataFrame, p: Pattern) -> DataFrame:
    """``(u, u2, n)``: the number of arcs between candidates of each pattern edge."""
    return match.candidate_edges(edges, p, match.dpiso_candidates(edges, p)).groupBy("u", "u2").agg(F.count("*").alias("n"))


def view_report(edges: DataFrame, capacity: int = 20_000) -> DataFrame:
    own = written(edges)
    return cluster.view_bins_report(own, written(cluster.view_bins(own, cluster.fennel(own, 4), capacity)), capacity)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "edges_norm": noted_graph,
        "degree": lambda s, d: graph.degrees(noted_graph(s, d)),
        "degree_hist": lambda s, d: graph.degree_histogram(noted_graph(s, d)),
        "max_degree": lambda s, d: graph.max_degree(noted_graph(s, d)),
        "id_range": lambda s, d: graph.id_range(noted_graph(s, d)),
        "preprocessed": lambda s, d: graph.preprocessed(load(s, d, "edges", "src", "dst")),
        "adjacency": lambda s, d: graph.adjacency(parts_graph(s, d)).select("v", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), ",").alias("nbrs"), "deg"),
        "two_hop_count": lambda s, d: graph.two_hop(parts_graph(s, d)).agg(F.count("*").alias("n")),
        "three_hop_count": lambda s, d: graph.k_hop(large_orders_graph(s, d), graph.degrees(large_orders_graph(s, d)), 3).agg(F.count("*").alias("n")),
        "split_by_order": lambda s, d: graph.split_by_order(graph.adjacency(parts_graph(s, d))).select("v", F.size("later").cast("bigint").alias("later"), F.size("earlier").cast("bigint").alias("earlier")),
        "noted_match_q0": lambda s, d: match.match_count(noted_graph(s, d), preset(0)),
        "noted_match_q24": lambda s, d: match.match_count(noted_graph(s, d), preset(24)),
        "noted_triangles": lambda s, d: match.triangles(noted_graph(s, d)).agg(F.count("*").alias("n")),
        "match_rows_q0": lambda s, d: match.prefix_rows(parts_graph(s, d), preset(0)),
        "match_rows_q24": lambda s, d: match.prefix_rows(parts_graph(s, d), preset(24)),
        "ldf_candidates_q14": lambda s, d: match.ldf_candidates(parts_graph(s, d), preset(14)),
        "dpiso_sizes_q14": lambda s, d: match.candidate_sizes(match.dpiso_candidates(large_orders_graph(s, d), preset(14))),
        "maximal_cliques": lambda s, d: sets.member_text(cliques.maximal_cliques(parts_graph(s, d))),
        "maximal_clique_count": lambda s, d: cliques.clique_statistics(cliques.maximal_cliques(parts_graph(s, d))),
        "maximal_clique_hist": lambda s, d: cliques.clique_histogram(cliques.maximal_cliques(parts_graph(s, d))),
        "maximal_clique_hist_by_level": lambda s, d: cliques.clique_histogram(cliques.maximal_cliques_by_level(parts_graph(s, d))),
        "maximal_clique_hist_app": lambda s, d: cliques.clique_histogram(app.run(app.CliqueSearch(), parts_graph(s, d))),
        "noted_clique_hist": lambda s, d: cliques.clique_histogram(cliques.maximal_cliques(noted_graph(s, d))),
        "core_number": lambda s, d: core.core_numbers(parts_graph(s, d)),
        "noted_core_number": lambda s, d: core.core_numbers(noted_graph(s, d)),
        "core_hist": lambda s, d: core.core_histogram(parts_graph(s, d)),
        "kmax": lambda s, d: core.kmax(parts_graph(s, d)),
        "degeneracy_order": lambda s, d: core.degeneracy_order(parts_graph(s, d)),
        "degeneracy_largest_later": lambda s, d: core.largest_later(core.degeneracy_recoded(parts_graph(s, d))),
        "k_core_8": lambda s, d: core.k_core(parts_graph(s, d), 8),
        "shell_bins": lambda s, d: core.shell_bins(parts_graph(s, d), 4).select("v", "bin"),
        "dedup_sets": lambda s, d: sets.member_text(sets.dedup_sets(order_sets(s, d))),
        "maximal_sets": lambda s, d: sets.member_text(sets.maximal_sets(order_sets(s, d))),
        "top2_sets": lambda s, d: sets.top_sets(order_sets(s, d)).select("rank", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members")),
        "quasi_cliques_1_of_4": lambda s, d: sets.member_text(quasi.quasi_cliques(parts_graph(s, d), (1, 1), 4)),
        "quasi_cliques_08_of_5": lambda s, d: sets.member_text(quasi.quasi_cliques(large_orders_graph(s, d), (4, 5), 5)),
        "quasi_cliques_06_of_5": lambda s, d: sets.member_text(quasi.quasi_cliques(large_orders_graph(s, d), (3, 5), 5)),
        "kernel_expand": lambda s, d: sets.member_text(quasi.kernel_expand(large_orders_graph(s, d), kernels(s, d), (4, 5), 4)),
        "kmeans_statistics": lambda s, d: kmeans_report(parts_graph(s, d)),
        "fennel_parts": lambda s, d: cluster.fennel(parts_graph(s, d), 4),
        "view_bins": lambda s, d: view_report(parts_graph(s, d)),
        "fennel_cut": lambda s, d: cluster.cut_edges(parts_graph(s, d), cluster.fennel(parts_graph(s, d), 4)),
        "label_counts": lambda s, d: graph.label_counts(with_label(noted_graph(s, d))),
        "neighbours_by_label": lambda s, d: graph.neighbours_by_label(noted_graph(s, d), with_label(noted_graph(s, d)), 1),
        "neighbours": lambda s, d: graph.neighbours(noted_graph(s, d), with_label(noted_graph(s, d)).where("label = 2")),
        "edge_probe": lambda s, d: graph.existing_edges(large_orders_graph(s, d).withColumnsRenamed({"src": "b", "dst": "a"}), parts_graph(s, d)),
        "list_sizes": lambda s, d: list_sizes(parts_graph(s, d)),
        "two_step_walks": lambda s, d: graph.two_step_walks(noted_graph(s, d)),
        "noted_k_core": lambda s, d: core.k_core(noted_graph(s, d), 5),
        "noted_match_q1": lambda s, d: match.match_count(noted_graph(s, d), preset(1)),
        "noted_match_q2": lambda s, d: match.match_count(noted_graph(s, d), preset(2)),
        "noted_match_q8": lambda s, d: match.match_count(noted_graph(s, d), preset(8)),
        "noted_match_candidate_q24": lambda s, d: match.candidate_count(noted_graph(s, d), preset(24)),
        "noted_dpiso_sizes_q14": lambda s, d: match.candidate_sizes(match.dpiso_candidates(written(noted_graph(s, d)), preset(14))),
        "parts_dpiso_sizes_q5": lambda s, d: match.candidate_sizes(match.dpiso_candidates(written(parts_graph(s, d)), preset(5))),
        "parts_match_candidate_q5": lambda s, d: match.candidate_count(parts_graph(s, d), preset(5)),
        "candidate_edges_q5": lambda s, d: _candidate_edges(written(large_orders_graph(s, d)), preset(5)),
        "split_bins": lambda s, d: cluster.split_bins(parts_graph(s, d), core.shell_bins(parts_graph(s, d), 3), 4),
    }
    for q in preset_numbers():
        out[f"match_q{q}"] = lambda s, d, q=q: match.match_count(parts_graph(s, d), preset(q))
    for q in (2, 8, 24):
        out[f"match_expand_q{q}"] = lambda s, d, q=q: match.expand_count(parts_graph(s, d), preset(q))
    for q in (5, 14, 25):
        out[f"match_candidate_q{q}"] = lambda s, d, q=q: match.candidate_count(large_orders_graph(s, d), preset(q))
    return out | roundtrips.queries() | {
        "p3_found": lambda s, d: skew.found_hubs(load(s, d, "edges")),
        "p3_vertex_loads": lambda s, d: skew.vertex_loads(load(s, d, "edges")),
        "p3_max_degree": lambda s, d: skew.max_degree(load(s, d, "edges")),
        "p3_file_hub_entries": lambda s, d: skew.file_hub_entries(load(s, d, "edges")),
        "p5_found": lambda s, d: lines.broken_lines(load(s, d, "raw_lines")),
        "p5_loaded": lambda s, d: lines.loaded_lines(load(s, d, "raw_lines")).withColumnsRenamed({"begin": "begin_id", "end": "end_id"}),
        "p5_repairs": lambda s, d: lines.repair_report(load(s, d, "raw_lines")),
    }


def _parts_sql(condition: str) -> str:
    return f"x AS MATERIALIZED (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE {condition}), g AS MATERIALIZED (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"


_MED, _BIG = _parts_sql("l_returnflag = 'R'"), _parts_sql("l_quantity >= 40")
_NOTED = "g AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM edges WHERE src <> dst)"
_ARC = ", arc AS MATERIALIZED (SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g), deg AS MATERIALIZED (SELECT src AS v, count(*) AS deg FROM arc GROUP BY src)"
_CLIQUE = ", adj AS MATERIALIZED (SELECT src AS v, list(dst) AS n FROM arc GROUP BY src), c(m, last, com) AS (SELECT [v], v, n FROM adj UNION ALL SELECT list_append(e.m, adj.v), adj.v, list_intersect(e.com, adj.n) FROM (SELECT m, last, com, unnest(com) AS u FROM c) e JOIN adj ON adj.v = e.u WHERE e.u > e.last), maximal AS (SELECT m FROM c WHERE len(com) = 0)"
_CORE = ", h(i, v, c) AS (SELECT 0, v, deg FROM deg UNION ALL SELECT i + 1, src, max(least(c, rk)) FROM (SELECT h.i, a.src, h.c, row_number() OVER (PARTITION BY a.src ORDER BY h.c DESC) AS rk FROM h JOIN arc a ON a.dst = h.v WHERE h.i < 60) GROUP BY i, src), cores AS MATERIALIZED (SELECT v, c AS core FROM h WHERE i = 60)"
_ORDER = ", ranked AS MATERIALIZED (SELECT v, core, deg, row_number() OVER (ORDER BY core, deg, v) - 1 AS id FROM cores JOIN deg USING (v))"
_SETS = "WITH s AS MATERIALIZED (SELECT DISTINCT list_sort(list_distinct(list(l_partkey))) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)"
_TEXT = "array_to_string(list_sort(m), ',') AS members"


def _dpiso_sql(p: Pattern, start: str, what: str) -> str:
    """The passes of ``dpiso_candidates`` as a chain of semi joins, once for each vertex that can be the root; the one that is has its candidates in ``c0``, ``c1``, ..."""
    roots = {}
    for u in range(p.n):
        if p.degree(u) > 1:
            roots.setdefault(p.degree(u), u)  # of the same degree, so with as many candidates, the first
    parts = [f"rooted AS (SELECT u FROM ({' UNION ALL '.join(f'SELECT {u} AS u, (SELECT count(*) FROM deg WHERE deg >= {d}) / {d} AS r' for d, u in roots.items())}) ORDER BY r, u LIMIT 1)"]
    for root in roots.values():
        order = filter_order(p, [0 if u == root else 10**6 for u in range(p.n)])
        around = tree(p, order)
        now = {u: f"(SELECT v FROM deg WHERE deg >= {p.degree(u)})" for u in range(p.n)}
        for number, (sequence, side) in enumerate(((order, 1), (order[::-1], 2), (order, 1))):
            for u in sequence:
                if around[u][side]:
                    near = " AND ".join(f"v IN (SELECT src FROM arc WHERE dst IN (SELECT v FROM {now[w]}))" for w in around[u][side])
                    name = f"r{root}_{number}_{u}"
                    parts.append(f"{name} AS MATERIALIZED (SELECT v FROM {now[u]} WHERE {near})")
                    now[u] = name
        parts.append(f"of_{root} AS (" + " UNION ALL ".join(f"SELECT {u} AS u, v FROM {now[u]} WHERE {root} = (SELECT u FROM rooted)" for u in range(p.n)) + ")")
    parts.append("c AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT u, v FROM of_{root}" for root in roots.values()) + ")")
    return f"{start}, {', '.join(parts)} {what}"


def _quasi_sql(start: str, share: tuple[int, int], least_size: int, most_size: int = 10) -> str:
    """The maximal quasi-cliques of up to ``most_size`` members, size by size.

    Without any one member a set of s that each have d neighbours inside leaves
    each d - 1. So sets are grown from edges, a neighbour at a time, within the core
    of d, and those with t members stay if each has d - (s - t) neighbours inside.
    """
    parts, ends = [_CORE.removeprefix(", "), "adj AS MATERIALIZED (SELECT src AS v, list(dst) AS n FROM arc GROUP BY src)"], []
    for size in range(least_size, most_size + 1):
        d = quasi.needed(share, size)
        k, e = f"k{size}", f"e{size}"
        parts.append(f"{k} AS MATERIALIZED (SELECT v FROM cores WHERE core >= {d}), {e} AS MATERIALIZED (SELECT src, dst FROM arc WHERE src IN (SELECT v FROM {k}) AND dst IN (SELECT v FROM {k}))")
        parts.append(f"s{size}_2 AS MATERIALIZED (SELECT [src, dst] AS m FROM {e} WHERE src < dst)")
        for t in range(3, size + 1):
            grown = f"SELECT DISTINCT list_sort(list_append(m, dst)) AS m FROM (SELECT m, unnest(m) AS u FROM s{size}_{t - 1}) x JOIN {e} ON src = u WHERE NOT list_contains(m, dst)"
            parts.append(f"s{size}_{t} AS MATERIALIZED (SELECT m FROM (SELECT m, unnest(m) AS u FROM ({grown})) y JOIN adj ON v = u GROUP BY m HAVING min(len(list_intersect(n, m))) >= {max(1, d - (size - t))})")
        ends.append(f"SELECT m FROM s{size}_{size}")
    parts.append(f"s AS MATERIALIZED ({' UNION ALL '.join(ends)}), one AS MATERIALIZED (SELECT m, unnest(m) AS u FROM s)")
    parts.append("inner_sets AS (SELECT DISTINCT a.m FROM (SELECT m, m[1] AS u FROM s) a JOIN one b ON a.u = b.u WHERE len(b.m) > len(a.m) AND list_has_all(b.m, a.m))")
    return f"{start}, {', '.join(parts)} SELECT {_TEXT} FROM s WHERE m NOT IN (SELECT m FROM inner_sets)"


#: Four parts, one vertex after the other; a state has the parts of the vertices so far and the sizes of the parts.
_FENNEL = (
    ", place AS MATERIALIZED (SELECT v, row_number() OVER (ORDER BY v) AS i FROM deg), nb AS MATERIALIZED (SELECT a.i, list(b.i) AS n FROM arc JOIN place a ON a.v = src JOIN place b ON b.v = dst WHERE b.i < a.i GROUP BY a.i),"
    " fixed AS MATERIALIZED (SELECT count(*) AS n, sqrt(4.0) * (SELECT count(*) FROM g) / pow(count(*), 1.5) AS alpha, 1.1 * count(*) / 4 AS cap FROM deg),"
    " f(i, part, size) AS (SELECT CAST(0 AS BIGINT), CAST([] AS INTEGER[]), CAST([0, 0, 0, 0] AS BIGINT[]) UNION ALL SELECT i + 1, list_append(part, k), [size[j] + CAST(j = k + 1 AS BIGINT) FOR j IN [1, 2, 3, 4]] FROM ("
    "SELECT i, part, size, CASE greatest(s[1], s[2], s[3], s[4]) WHEN s[1] THEN 0 WHEN s[2] THEN 1 WHEN s[3] THEN 2 ELSE 3 END AS k FROM ("
    "SELECT f.i, part, size, [CASE WHEN size[j] <= cap THEN len(list_filter(coalesce(nb.n, []), lambda x: part[x] = j - 1)) - alpha * (pow(size[j] + 1.0, 1.5) - pow(CAST(size[j] AS DOUBLE), 1.5)) END FOR j IN [1, 2, 3, 4]] AS s"
    " FROM f CROSS JOIN fixed LEFT JOIN nb ON nb.i = f.i + 1 WHERE f.i < fixed.n))),"
    " fennel AS MATERIALIZED (SELECT v, part[i] AS part FROM place CROSS JOIN (SELECT part FROM f, fixed WHERE f.i = fixed.n))"
)
#: Three bins of the shells, the one of largest load split.
_SPLIT = (
    ", shell AS MATERIALIZED (SELECT v, deg, CAST(floor((id - first) / (floor(n / 3) + 1)) AS BIGINT) AS bin FROM (SELECT v, deg, id, min(id) OVER (PARTITION BY core) AS first, count(*) OVER (PARTITION BY core) AS n FROM ranked)),"
    " top AS (SELECT bin FROM shell GROUP BY bin ORDER BY sum(deg) DESC, bin LIMIT 1), dealt AS MATERIALIZED (SELECT v, deg, CASE WHEN bin = (SELECT bin FROM top) AND row_number() OVER (PARTITION BY bin ORDER BY deg DESC, v) % 2 = 0 THEN 3 ELSE bin END AS bin FROM shell),"
    " named AS (SELECT bin, row_number() OVER (ORDER BY sum(deg) DESC, bin) - 1 AS new FROM dealt GROUP BY bin)"
)


def _graph_sql() -> dict[str, str]:
    med, noted = f"WITH RECURSIVE {_MED}{_ARC}", f"WITH RECURSIVE {_NOTED}{_ARC}"
    big = f"WITH RECURSIVE {_BIG}{_ARC}"
    out = {
        "edges_norm": f"WITH {_NOTED} SELECT src, dst FROM g",
        "degree": f"{noted} SELECT v, deg FROM deg",
        "degree_hist": f"{noted} SELECT deg, count(*) AS vertices FROM deg GROUP BY deg",
        "max_degree": f"{noted} SELECT max(deg) AS max_degree FROM deg",
        "id_range": f"{noted} SELECT min(v) AS min_id, max(v) AS max_id, count(*) AS vertices, (SELECT count(*) FROM g) AS edges FROM deg",
        "preprocessed": f"{noted}, n AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS id FROM deg) SELECT a.id AS src, b.id AS dst FROM g JOIN n a ON a.v = src JOIN n b ON b.v = dst",
        "adjacency": f"{med} SELECT src AS v, array_to_string(list(dst ORDER BY dst), ',') AS nbrs, count(*) AS deg FROM arc GROUP BY src",
        "two_hop_count": f"{med} SELECT count(*) AS n FROM (SELECT src AS a, dst AS b FROM arc UNION SELECT x.src, y.dst FROM arc x JOIN arc y ON x.dst = y.src WHERE x.src <> y.dst)",
        "three_hop_count": f"{big}, one AS MATERIALIZED (SELECT v AS s, v FROM deg UNION SELECT src, dst FROM arc), two AS MATERIALIZED (SELECT s, v FROM one UNION SELECT s, dst FROM one JOIN arc ON src = v) SELECT count(*) AS n FROM (SELECT s, v FROM two UNION SELECT s, dst FROM two JOIN arc ON src = v)",
        "split_by_order": f"{med} SELECT src AS v, count(*) FILTER (dst > src) AS later, count(*) FILTER (dst < src) AS earlier FROM arc GROUP BY src",
        "noted_triangles": match_sql(preset(0), _NOTED),
        "noted_match_q0": match_sql(preset(0), _NOTED),
        "noted_match_q24": match_sql(preset(24), _NOTED),
        "match_rows_q0": match_sql(preset(0), _MED, rows=True),
        "match_rows_q24": match_sql(preset(24), _MED, rows=True),
        "ldf_candidates_q14": f"{med} SELECT CAST(u AS INTEGER) AS u, v FROM (VALUES " + ", ".join(f"({u}, {preset(14).degree(u)})" for u in range(7)) + ") p(u, least_deg) JOIN deg ON deg >= least_deg",
        "maximal_cliques": f"{med}{_CLIQUE} SELECT {_TEXT} FROM maximal",
        "maximal_clique_count": f"{med}{_CLIQUE} SELECT count(*) AS cliques, CAST(max(len(m)) AS INTEGER) AS largest FROM maximal",
        "core_number": f"{med}{_CORE} SELECT v, core FROM cores",
        "noted_core_number": f"{noted}{_CORE} SELECT v, core FROM cores",
        "core_hist": f"{med}{_CORE} SELECT core, count(*) AS vertices FROM cores GROUP BY core",
        "kmax": f"{med}{_CORE} SELECT max(core) AS kmax FROM cores",
        "degeneracy_order": f"{med}{_CORE}{_ORDER} SELECT v, core, deg, id FROM ranked",
        "degeneracy_largest_later": f"{med}{_CORE}{_ORDER} SELECT max(n) AS largest_later FROM (SELECT least(a.id, b.id) AS low, count(*) AS n FROM g JOIN ranked a ON a.v = src JOIN ranked b ON b.v = dst GROUP BY 1)",
        "k_core_8": f"{med}{_CORE} SELECT src, dst FROM g WHERE src IN (SELECT v FROM cores WHERE core >= 8) AND dst IN (SELECT v FROM cores WHERE core >= 8)",
        "shell_bins": f"{med}{_CORE}{_ORDER} SELECT v, CAST(floor((id - first) / (floor(n / 4) + 1)) AS INTEGER) AS bin FROM (SELECT v, id, min(id) OVER (PARTITION BY core) AS first, count(*) OVER (PARTITION BY core) AS n FROM ranked)",
        "dedup_sets": f"{_SETS} SELECT {_TEXT} FROM s",
        "maximal_sets": f"{_SETS}, one AS MATERIALIZED (SELECT m, unnest(m) AS u FROM s), inner_sets AS (SELECT DISTINCT a.m FROM (SELECT m, m[1] AS u FROM s) a JOIN one b ON a.u = b.u WHERE len(b.m) > len(a.m) AND list_has_all(b.m, a.m)) SELECT {_TEXT} FROM s WHERE m NOT IN (SELECT m FROM inner_sets)",
        "top2_sets": f"{_SETS} SELECT CAST(row_number() OVER (ORDER BY len(m) DESC, m) AS INTEGER) AS rank, {_TEXT} FROM s ORDER BY len(m) DESC, m LIMIT 2",
        "quasi_cliques_1_of_4": f"{med}{_CLIQUE} SELECT {_TEXT} FROM maximal WHERE len(m) >= 4",
    }
    shared = "FROM g JOIN arc a ON a.src = g.src JOIN arc b ON b.src = g.dst AND b.dst = a.dst GROUP BY g.src, g.dst"
    out |= {
        "dpiso_sizes_q14": _dpiso_sql(preset(14), big, "SELECT CAST(x.u AS INTEGER) AS u, count(c.v) AS candidates FROM (SELECT unnest(range(7)) AS u) x LEFT JOIN c ON c.u = x.u GROUP BY x.u"),
        "noted_dpiso_sizes_q14": _dpiso_sql(preset(14), noted, "SELECT CAST(x.u AS INTEGER) AS u, count(c.v) AS candidates FROM (SELECT unnest(range(7)) AS u) x LEFT JOIN c ON c.u = x.u GROUP BY x.u"),
        "parts_dpiso_sizes_q5": _dpiso_sql(preset(5), med, "SELECT CAST(x.u AS INTEGER) AS u, count(c.v) AS candidates FROM (SELECT unnest(range(5)) AS u) x LEFT JOIN c ON c.u = x.u GROUP BY x.u"),
        "candidate_edges_q5": _dpiso_sql(preset(5), big, "SELECT CAST(p.u AS INTEGER) AS u, CAST(u2 AS INTEGER) AS u2, count(*) AS n FROM (VALUES " + ", ".join(f"({u}, {w})" for u, w in sorted(preset(5).edges)) + ") p(u, u2) JOIN c a ON a.u = p.u JOIN arc ON src = a.v JOIN c b ON b.u = p.u2 AND b.v = dst GROUP BY p.u, u2"),
        "quasi_cliques_08_of_5": _quasi_sql(big, (4, 5), 5),
        "quasi_cliques_06_of_5": _quasi_sql(big, (3, 5), 5),
        # each of them has three members adjacent to one another
        "kernel_expand": _quasi_sql(big, (4, 5), 4),
        "kmeans_statistics": f"{med} SELECT count(*) AS vertices, true AS few, true AS sound FROM deg",
        "fennel_parts": f"{med}{_FENNEL} SELECT v, part FROM fennel",
        "fennel_cut": f"{med}{_FENNEL} SELECT count(*) FILTER (a.part <> b.part) AS cut, count(*) AS edges FROM g JOIN fennel a ON a.v = src JOIN fennel b ON b.v = dst",
        "view_bins": f"{med} SELECT v, CAST(1 AS BIGINT) AS bins, true AS fits FROM deg",
        "split_bins": f"{med}{_CORE}{_ORDER}{_SPLIT} SELECT v, CAST(new AS INTEGER) AS bin FROM dealt JOIN named USING (bin)",
        "label_counts": f"{noted} SELECT CAST(v % 4 AS INTEGER) AS label, count(*) AS vertices FROM deg GROUP BY v % 4",
        "neighbours_by_label": f"{noted} SELECT src AS v, dst AS nbr FROM arc WHERE dst % 4 = 1",
        "neighbours": f"{noted} SELECT src AS v, dst AS nbr FROM arc WHERE src % 4 = 2",
        "edge_probe": f"WITH {_MED}, {_BIG.replace('x AS', 'y AS').replace('g AS', 'h AS').replace('x a JOIN x b', 'y a JOIN y b')} SELECT h.src AS b, h.dst AS a FROM h JOIN g USING (src, dst)",
        "list_sizes": f"{med}, c AS (SELECT g.src, g.dst, count(*) AS common {shared}) SELECT src, dst, coalesce(common, 0) AS common, deg - coalesce(common, 0) AS only_src, coalesce(common, 0) AS probed, deg - 1 = coalesce(common, 0) AS within FROM g LEFT JOIN c USING (src, dst) JOIN deg ON v = src",
        "two_step_walks": f"{noted} SELECT src AS v, CAST(sum(deg - 1) AS BIGINT) AS walks FROM arc JOIN deg ON v = dst GROUP BY src",
        "noted_k_core": f"{noted}{_CORE} SELECT src, dst FROM g WHERE src IN (SELECT v FROM cores WHERE core >= 5) AND dst IN (SELECT v FROM cores WHERE core >= 5)",
        "noted_match_candidate_q24": match_sql(preset(24), _NOTED),
        "parts_match_candidate_q5": match_sql(preset(5), _MED),
        **{f"noted_match_q{q}": match_sql(preset(q), _NOTED) for q in (1, 2, 8)},
    }
    for name, start in (("maximal_clique_hist", med), ("maximal_clique_hist_by_level", med), ("maximal_clique_hist_app", med), ("noted_clique_hist", noted)):
        out[name] = f"{start}{_CLIQUE} SELECT CAST(len(m) AS INTEGER) AS size, count(*) AS cliques FROM maximal GROUP BY 1"
    for q in preset_numbers():
        out[f"match_q{q}"] = match_sql(preset(q), _MED)
    for q in (2, 8, 24):
        out[f"match_expand_q{q}"] = match_sql(preset(q), _MED)
    for q in (5, 14, 25):
        out[f"match_candidate_q{q}"] = match_sql(preset(q), _BIG)
    return out


_P3 = """
WITH ends AS (
  SELECT src AS v, CASE WHEN src = dst THEN NULL ELSE dst END AS nbr, file_id FROM edges WHERE src IS NOT NULL
  UNION ALL
  SELECT dst, src, file_id FROM edges WHERE dst IS NOT NULL AND (src IS NULL OR src <> dst)),
loads AS (SELECT v, count(*) AS entries, count(DISTINCT nbr) AS neighbours FROM ends GROUP BY v)
"""

_P5 = r"""
WITH record AS (
  SELECT line_id, line FROM raw_lines
  WHERE line IS NOT NULL AND line NOT LIKE '#%' AND NOT regexp_full_match(line, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]*')),
cut AS (
  SELECT line_id, line,
    regexp_full_match(line, '(?s)(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*') AS quotes_ok,
    regexp_full_match(line, '(?s)(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*)){3}') AS columns_ok,
    regexp_extract(line, '(?s)^("(?:[^"]|"")*"|[^"\t]*)\t("(?:[^"]|"")*"|[^"\t]*)\t("(?:[^"]|"")*"|[^"\t]*)\t("(?:[^"]|"")*"|[^"\t]*)$', ['b', 'e', 't', 'r']) AS f
  FROM record),
bare AS (
  SELECT line_id, quotes_ok, columns_ok,
    CASE WHEN f.b LIKE '"%' THEN replace(f.b[2:-2], '""', '"') ELSE f.b END AS b,
    CASE WHEN f.e LIKE '"%' THEN replace(f.e[2:-2], '""', '"') ELSE f.e END AS e,
    CASE WHEN f.t LIKE '"%' THEN replace(f.t[2:-2], '""', '"') ELSE f.t END AS tag,
    CASE WHEN f.r LIKE '"%' THEN replace(f.r[2:-2], '""', '"') ELSE f.r END AS remark
  FROM cut),
checked AS (
  SELECT *, CASE WHEN NOT quotes_ok THEN 'quoting' WHEN NOT columns_ok THEN 'columns'
    WHEN NOT regexp_full_match(b, '[0-9]+') OR TRY_CAST(b AS HUGEINT) IS NULL OR TRY_CAST(b AS HUGEINT) > 4294967295 THEN 'begin'
    WHEN NOT regexp_full_match(e, '[0-9]+') OR TRY_CAST(e AS HUGEINT) IS NULL OR TRY_CAST(e AS HUGEINT) > 4294967295 THEN 'end' END AS reason
  FROM bare)
"""


def oracle_sql() -> dict[str, str]:
    return _graph_sql() | roundtrips.oracle_sql() | {
        "p3_found": _P3 + "SELECT v FROM loads WHERE entries * 100 > (SELECT count(*) FROM edges)",
        "p3_vertex_loads": _P3 + "SELECT v, entries, neighbours FROM loads",
        "p3_max_degree": _P3 + "SELECT max(neighbours) AS max_degree FROM loads",
        "p3_file_hub_entries": _P3 + "SELECT file_id, count(*) AS hub_entries FROM ends JOIN loads USING (v) WHERE entries >= 1000 GROUP BY file_id",
        "p5_found": _P5 + "SELECT line_id, reason FROM checked WHERE reason IS NOT NULL",
        "p5_repairs": _P5 + "SELECT line_id, reason, true AS in_place, CASE WHEN reason <> 'quoting' THEN abs(length(bare_line) - length(replace(bare_line, chr(9), '')) - 3) END AS delimiters FROM checked JOIN (SELECT line_id, regexp_replace(line, '\"(?:[^\"]|\"\")*\"', '', 'g') AS bare_line FROM record) USING (line_id) WHERE reason IS NOT NULL",
        "p5_loaded": _P5 + "SELECT line_id, CAST(b AS BIGINT) AS begin_id, CAST(e AS BIGINT) AS end_id, tag, remark FROM checked WHERE reason IS NULL",
    }
