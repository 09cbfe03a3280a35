"""DuckDB statements that give the rows of the registered graph queries."""

from __future__ import annotations

from graphloom.derived import SQL


def _edges(name: str) -> str:
    return f"edges AS MATERIALIZED ({SQL[name]})"


def _arcs(name: str, directed: bool = False) -> str:
    back = "" if directed else " UNION ALL SELECT dst, src FROM edges"
    return f"{_edges(name)}, arcs AS MATERIALIZED (SELECT src, dst FROM edges{back}), verts AS MATERIALIZED (SELECT src AS vid FROM edges UNION SELECT dst FROM edges)"


def info(name: str) -> str:
    return f"WITH {_arcs(name)} SELECT (SELECT count(*) FROM verts) AS vertices, (SELECT count(*) FROM edges) AS edges, (SELECT max(vid) FROM verts) AS max_id"


def degrees(name: str, directed: bool) -> str:
    return (
        f"WITH {_arcs(name, directed)} SELECT vid, CAST(coalesce(o, 0) AS BIGINT) AS out_degree, CAST(coalesce(i, 0) AS BIGINT) AS in_degree FROM verts "
        "LEFT JOIN (SELECT src AS vid, count(*) AS o FROM arcs GROUP BY 1) USING (vid) LEFT JOIN (SELECT dst AS vid, count(*) AS i FROM arcs GROUP BY 1) USING (vid)"
    )


def strengths(name: str) -> str:
    return f"WITH {_edges(name)} SELECT vid, coalesce(sum(w), 0) AS strength FROM (SELECT src AS vid, weight AS w FROM edges UNION ALL SELECT dst, 0 FROM edges) GROUP BY vid"


def distribution(name: str) -> str:
    return f"WITH {_arcs(name)} SELECT out_degree, count(*) AS vertices FROM (SELECT src, count(*) AS out_degree FROM arcs GROUP BY src) GROUP BY out_degree"


def density(name: str) -> str:
    return f"WITH {_arcs(name)}, v AS (SELECT CAST(count(*) AS DOUBLE) AS v FROM verts) SELECT round(2.0 * (SELECT count(*) FROM edges) / (v * (v - 1)), 9) AS density FROM v"


def _levels(name: str, roots: str, directed: bool = False, limit: int = 40) -> str:
    """lv(root, vid, dist): fewest hops from each root."""
    return (
        f"{_arcs(name, directed)}, roots AS MATERIALIZED ({roots}), walk(root, vid, dist) AS (SELECT root, root, 0 FROM roots UNION "
        f"SELECT root, dst, dist + 1 FROM walk JOIN arcs ON vid = src WHERE dist < {limit}), "
        "lv AS MATERIALIZED (SELECT root, vid, min(dist) AS dist FROM walk GROUP BY root, vid)"
    )


def bfs(name: str, root: int) -> str:
    return (
        f"WITH RECURSIVE {_levels(name, f'SELECT CAST({root} AS BIGINT) AS root', True)}, up AS (SELECT a.vid, min(src) AS parent FROM lv a JOIN arcs ON dst = a.vid "
        "JOIN lv b ON b.vid = src AND b.dist = a.dist - 1 GROUP BY a.vid) SELECT vid, CAST(dist AS INTEGER) AS level, parent FROM lv LEFT JOIN up USING (vid)"
    )


def tree(name: str, root: int) -> str:
    return (
        f"WITH RECURSIVE {_levels(name, f'SELECT CAST({root} AS BIGINT) AS root', True)}, c AS (SELECT dist, count(*) AS n FROM lv GROUP BY dist) "
        "SELECT (SELECT coalesce(max(n), 0) FROM c WHERE dist > 0) AS width, (SELECT count(*) FROM c) AS depth, "
        "(SELECT max(n) <= 1 FROM (SELECT count(*) AS n FROM edges GROUP BY dst)) AS is_tree"
    )


LOW_ROOTS = "SELECT vid AS root FROM verts ORDER BY vid LIMIT 5"


def hop_pairs(name: str, limit: int) -> str:
    return f"WITH RECURSIVE {_levels(name, LOW_ROOTS, False, limit)} SELECT root, vid, CAST(dist AS INTEGER) AS dist FROM lv"


def closeness(name: str) -> str:
    return f"WITH RECURSIVE {_levels(name, LOW_ROOTS)} SELECT root, round(CASE WHEN sum(dist) > 0 THEN ((SELECT count(*) FROM verts) - 1) / sum(dist)::DOUBLE ELSE 0 END, 9) AS closeness FROM lv GROUP BY root"


def _components(name: str) -> str:
    return (
        f"{_arcs(name)}, reach(vid, o) AS (SELECT vid, vid FROM verts UNION SELECT dst, o FROM reach JOIN arcs ON vid = src WHERE o < dst), "
        "named AS MATERIALIZED (SELECT vid, min(o) AS label FROM reach GROUP BY vid)"
    )


def _major() -> str:
    return "major AS MATERIALIZED (SELECT label FROM named GROUP BY label ORDER BY count(*) DESC, label LIMIT 1), inside AS MATERIALIZED (SELECT vid FROM named JOIN major USING (label))"


def components(name: str) -> str:
    return f"WITH RECURSIVE {_components(name)} SELECT vid, label FROM named"


def component_sizes(name: str) -> str:
    return (
        f"WITH RECURSIVE {_components(name)} SELECT label, vertices, CAST(coalesce(edges, 0) AS BIGINT) AS edges FROM (SELECT label, count(*) AS vertices FROM named GROUP BY label) "
        "LEFT JOIN (SELECT label, count(*) AS edges FROM edges JOIN named ON src = vid GROUP BY label) USING (label)"
    )


def component_edges(name: str, major: bool) -> str:
    only = " WHERE label IN (SELECT label FROM major)" if major else ""
    return f"WITH RECURSIVE {_components(name)}, {_major()} SELECT label, least(src, dst) AS src, greatest(src, dst) AS dst FROM edges JOIN named ON src = vid{only}"


def encoded(name: str) -> str:
    return f"WITH {_arcs(name)}, c AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS code FROM verts) SELECT a.code AS src, b.code AS dst FROM edges JOIN c a ON a.vid = src JOIN c b ON b.vid = dst"


def pagerank(name: str, rounds: int, weighted: bool = False) -> str:
    w = "weight" if weighted else "1.0"
    arcs = f"{_edges(name)}, arcs AS (SELECT src, dst, {w} AS w FROM edges" + ("" if weighted else " UNION ALL SELECT dst, src, 1.0 FROM edges") + ")"
    parts = [arcs, "verts AS (SELECT src AS vid FROM edges UNION SELECT dst FROM edges)", "share AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS s FROM arcs)", "r0 AS (SELECT vid, 1.0::DOUBLE AS r FROM verts)"]
    for n in range(rounds):
        parts.append(f"r{n + 1} AS MATERIALIZED (SELECT v.vid, 0.15 + 0.85 * coalesce(g, 0) AS r FROM verts v LEFT JOIN (SELECT dst AS vid, sum(s * r) AS g FROM share JOIN r{n} ON src = vid GROUP BY dst) USING (vid))")
    return f"WITH {', '.join(parts)} SELECT vid, round(r, 6) AS rank FROM r{rounds}"


def label_propagation(name: str, rounds: int) -> str:
    parts = [_arcs(name), "l0 AS (SELECT vid, vid AS label FROM verts)"]
    for n in range(rounds):
        parts.append(
            f"l{n + 1} AS MATERIALIZED (SELECT vid, label FROM (SELECT dst AS vid, label, row_number() OVER (PARTITION BY dst ORDER BY count(*) DESC, label) AS k "
            f"FROM arcs JOIN l{n} ON src = vid GROUP BY dst, label) WHERE k = 1)"
        )
    return f"WITH {', '.join(parts)} SELECT vid, label FROM l{rounds}"


def hop_attenuation(name: str, rounds: int, attenuation: float, tolerance: float) -> str:
    parts = [_arcs(name), "l0 AS (SELECT vid, vid AS label, 1.0::DOUBLE AS score FROM verts)"]
    for n in range(rounds):
        parts.append(
            f"s{n} AS (SELECT dst AS vid, label, sum(score) AS w, max(score) AS best FROM arcs JOIN l{n} ON src = vid WHERE score >= 0 GROUP BY dst, label), "
            f"t{n} AS (SELECT *, max(w) OVER (PARTITION BY vid) AS top FROM s{n}), "
            f"b{n} AS (SELECT vid, label, best, row_number() OVER (PARTITION BY vid ORDER BY label) AS k FROM t{n} WHERE w >= top - {tolerance}), "
            f"l{n + 1} AS MATERIALIZED (SELECT o.vid, coalesce(b.label, o.label) AS label, "
            f"CASE WHEN b.label IS NULL THEN 0.0 ELSE b.best - CASE WHEN b.label <> o.label THEN {attenuation} ELSE 0 END END AS score "
            f"FROM l{n} o LEFT JOIN (SELECT * FROM b{n} WHERE k = 1) b USING (vid))"
        )
    return f"WITH {', '.join(parts)} SELECT vid, label, round(score, 6) AS score FROM l{rounds}"


def _coreness(name: str) -> str:
    """h-indices of the neighbours' estimates until nothing moves."""
    return (
        f"{_arcs(name)}, c AS (SELECT 0 AS n, dst AS vid, count(*) AS c, true AS moved FROM arcs GROUP BY dst UNION ALL "
        "SELECT n + 1, vid, h, h < old FROM (SELECT n, vid, old, max(least(k, e)) AS h FROM ("
        "SELECT a.n AS n, dst AS vid, b.c AS old, least(a.c, b.c) AS e, row_number() OVER (PARTITION BY dst ORDER BY least(a.c, b.c) DESC) AS k "
        "FROM arcs JOIN c a ON src = a.vid JOIN c b ON dst = b.vid WHERE (SELECT bool_or(moved) FROM c)) GROUP BY n, vid, old)), "
        "core AS MATERIALIZED (SELECT vid, CAST(c AS BIGINT) AS coreness FROM c WHERE n = (SELECT max(n) FROM c))"
    )


def coreness(name: str) -> str:
    return f"WITH RECURSIVE {_coreness(name)} SELECT vid, coreness FROM core"


def shell_sizes(name: str) -> str:
    return f"WITH RECURSIVE {_coreness(name)} SELECT coreness, count(*) AS arcs FROM arcs JOIN core ON src = vid GROUP BY coreness"


def core_edges(name: str, k: int) -> str:
    return f"WITH RECURSIVE {_coreness(name)} SELECT src, dst FROM edges WHERE src IN (SELECT vid FROM core WHERE coreness >= {k}) AND dst IN (SELECT vid FROM core WHERE coreness >= {k})"


def filled(name: str) -> str:
    return f"WITH {_arcs(name)} SELECT vid, 7 AS value FROM verts"


def updated(name: str) -> str:
    return (
        f"WITH {_arcs(name)}, new AS (SELECT dst AS vid, min(src) AS new FROM edges GROUP BY dst) "
        "SELECT vid, CASE WHEN new * 4 < vid * 2 THEN new ELSE vid * 2 END AS value FROM verts LEFT JOIN new USING (vid) WHERE vid % 2 = 0"
    )


def spread_sums(name: str) -> str:
    return f"WITH {_arcs(name)} SELECT vid % 10 AS key, CAST(sum(vid) AS BIGINT) AS total, count(*) AS n FROM verts WHERE vid % 3 <> 0 GROUP BY 1"


def distinct_neighbours(name: str) -> str:
    return f"WITH {_arcs(name)} SELECT src AS vid, count(DISTINCT dst) AS exact, true AS close FROM arcs GROUP BY src"


def n_step_band(name: str, step: int) -> str:
    return f"SELECT vid, in_degree, true AS close FROM ({n_step_degrees(name, step)})"


def _cut(k: int) -> str:
    return f"cut AS MATERIALIZED (SELECT src % {k} AS a, dst % {k} AS b, CAST(count(*) AS DOUBLE) AS w FROM arcs GROUP BY 1, 2)"


def modularity(name: str, k: int) -> str:
    return (
        f"WITH {_arcs(name)}, {_cut(k)}, s AS (SELECT a, sum(w) AS k, sum(CASE WHEN a = b THEN w ELSE 0 END) AS inside FROM cut GROUP BY a), "
        "t AS (SELECT sum(w) AS total FROM cut) SELECT round(sum(inside / total - (k / total) * (k / total)), 9) AS modularity FROM s, t"
    )


def code_length(name: str, k: int) -> str:
    """The two-level map equation of undirected flow."""
    plogp = "CASE WHEN {0} > 0 THEN {0} * log2({0}) ELSE 0 END".format
    return (
        f"WITH {_arcs(name)}, {_cut(k)}, t AS (SELECT sum(w) AS total FROM cut), m AS (SELECT a, sum(w / total) AS flow, sum(CASE WHEN a <> b THEN w / total ELSE 0 END) AS leave FROM cut, t GROUP BY a), "
        f"v AS (SELECT src, count(*) / max(total) AS p FROM arcs, t GROUP BY src), x AS (SELECT sum(leave) AS q FROM m) "
        f"SELECT round((SELECT {plogp('q')} FROM x) + (SELECT sum({plogp('(leave + flow)')} - 2 * ({plogp('leave')})) FROM m) - (SELECT sum({plogp('p')}) FROM v), 6) AS code_length"
    )


def walk_facts(name: str, steps: int, starts: str = "") -> str:
    return (
        f"WITH {_arcs(name)} SELECT step, walks, CAST(0 AS BIGINT) AS no_arc, CAST(0 AS BIGINT) AS odd_type "
        f"FROM range({steps}) AS t(step), (SELECT count(*) AS walks FROM verts {starts})"
    )


WEIGHTED_EDGES = "SELECT l_orderkey AS src, l_partkey AS dst, CAST(l_quantity AS BIGINT) AS weight FROM lineitem"


MAJOR_ROOTS = "SELECT vid AS root FROM inside ORDER BY vid LIMIT 5"


def _major_levels(name: str) -> str:
    return (
        f"{_components(name)}, {_major()}, roots AS MATERIALIZED ({MAJOR_ROOTS}), walk(root, vid, dist) AS (SELECT root, root, 0 FROM roots UNION SELECT root, dst, dist + 1 FROM walk JOIN arcs ON vid = src "
        "WHERE dist < 40), lv AS MATERIALIZED (SELECT root, vid, min(dist) AS dist FROM walk GROUP BY root, vid)"
    )


def sampled_closeness(name: str) -> str:
    return (
        f"WITH RECURSIVE {_major_levels(name)}, n AS (SELECT count(*)::DOUBLE AS n FROM inside), t AS (SELECT vid, sum(dist) AS total FROM lv GROUP BY vid) "
        "SELECT vid, round(CASE WHEN total > 0 THEN 5 * (n - 1) / (n * total) ELSE 0 END, 9) AS closeness FROM verts LEFT JOIN t USING (vid), n"
    )


def sampled_betweenness(name: str, depth: int) -> str:
    """Brandes, level by level; the graph must be no deeper than ``depth`` from the roots."""
    parts = [_major_levels(name), "p0 AS (SELECT root, root AS vid, 1.0::DOUBLE AS sigma FROM roots)"]
    for d in range(1, depth + 1):
        parts.append(f"p{d} AS MATERIALIZED (SELECT lv.root, lv.vid, sum(sigma) AS sigma FROM lv JOIN arcs ON dst = lv.vid JOIN p{d - 1} p ON p.root = lv.root AND p.vid = src WHERE dist = {d} GROUP BY lv.root, lv.vid)")
    parts.append(f"d{depth} AS (SELECT root, vid, sigma, 0.0::DOUBLE AS delta FROM p{depth})")
    for d in range(depth - 1, -1, -1):
        parts.append(
            f"d{d} AS MATERIALIZED (SELECT p.root, p.vid, p.sigma, p.sigma * coalesce(x.part, 0) AS delta FROM p{d} p LEFT JOIN (SELECT b.root, src AS vid, sum((1 + delta) / sigma) AS part "
            f"FROM d{d + 1} b JOIN arcs ON dst = b.vid GROUP BY b.root, src) x ON x.root = p.root AND x.vid = p.vid)"
        )
    union = " UNION ALL ".join(f"SELECT * FROM d{d}" for d in range(1, depth + 1))
    return (
        f"WITH RECURSIVE {', '.join(parts)}, s AS (SELECT vid, sum(delta) AS delta FROM ({union}) WHERE vid <> root GROUP BY vid) "
        "SELECT vid, round(coalesce(delta, 0) * (SELECT count(*) FROM inside) / 5, 6) AS betweenness FROM verts LEFT JOIN s USING (vid)"
    )


def average_distance(name: str) -> str:
    return f"WITH RECURSIVE {_levels(name, 'SELECT vid AS root FROM verts')} SELECT round(avg(dist), 9) AS average_distance FROM lv WHERE dist > 0"


def n_step_degrees(name: str, step: int) -> str:
    return f"WITH RECURSIVE {_levels(name, 'SELECT vid AS root FROM verts', False, step)} SELECT root AS vid, count(*) - 1 AS in_degree, count(*) - 1 AS out_degree FROM lv GROUP BY root"


def mutual(name: str, lists: bool) -> str:
    listed = ", coalesce(array_to_string(l, ':'), '') AS common" if lists else ""
    return (
        f"WITH {_arcs(name)}, c AS (SELECT e.src, e.dst, count(*) AS n, list(a.dst ORDER BY a.dst) AS l FROM edges e JOIN arcs a ON a.src = e.src JOIN arcs b ON b.src = e.dst AND b.dst = a.dst "
        f"GROUP BY e.src, e.dst) SELECT e.src, e.dst, CAST(coalesce(n, 0) AS BIGINT) AS n{listed} FROM edges e LEFT JOIN c ON c.src = e.src AND c.dst = e.dst"
    )


def mutual_items(name: str) -> str:
    return (
        f"WITH {_arcs(name)}, items AS (SELECT DISTINCT l_partkey AS vid, l_suppkey AS item FROM lineitem) SELECT e.src, e.dst, CAST(count(b.item) AS BIGINT) AS n "
        "FROM edges e LEFT JOIN items a ON a.vid = e.src LEFT JOIN items b ON b.vid = e.dst AND b.item = a.item GROUP BY e.src, e.dst"
    )


def spread(friends: bool) -> str:
    listed = ", array_to_string(list_sort(list(DISTINCT dst)), ':') AS friends" if friends else ""
    return (
        f"WITH {_arcs('g_pp')}, b AS (SELECT l_partkey AS vid, l_suppkey AS behaviour_id, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY 1, 2) "
        f"SELECT src, behaviour_id, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS sum_quantity{listed} FROM arcs JOIN b ON dst = vid GROUP BY src, behaviour_id"
    )


def convolve(name: str, rounds: int) -> str:
    parts = [_arcs(name), "f0 AS (SELECT vid, pos, CAST((vid % (pos + 7)) AS DOUBLE) * CAST(0.3 AS DOUBLE) AS f FROM verts, range(0, 4) t(pos))", "deg AS (SELECT dst AS vid, count(*) AS n FROM arcs GROUP BY dst)"]
    for n in range(rounds):
        parts.append(f"f{n + 1} AS MATERIALIZED (SELECT o.vid, o.pos, (o.f + s) / n AS f FROM f{n} o JOIN deg USING (vid) JOIN (SELECT dst AS vid, pos, sum(f) AS s FROM arcs JOIN f{n} ON src = vid GROUP BY dst, pos) USING (vid, pos))")
    return f"WITH {', '.join(parts)} SELECT vid, CAST(pos AS INTEGER) AS pos, round(f, 6) AS f FROM f{rounds}"


def subsets(name: str) -> str:
    return (
        f"WITH {_arcs(name)}, a AS (SELECT DISTINCT src AS vid FROM edges WHERE src % 3 <> 0), b AS (SELECT vid FROM verts WHERE vid % 2 = 0) "
        "SELECT 'union' AS op, count(*) AS members, max(vid) AS last FROM (SELECT vid FROM a UNION SELECT vid FROM b) UNION ALL "
        "SELECT 'intersection', count(*), max(vid) FROM (SELECT vid FROM a INTERSECT SELECT vid FROM b) UNION ALL SELECT 'difference', count(*), max(vid) FROM (SELECT vid FROM a EXCEPT SELECT vid FROM b)"
    )


def state(name: str) -> str:
    return (
        f"WITH {_arcs(name)}, old AS (SELECT vid, vid * 2 AS value FROM verts WHERE vid % 2 = 0), new AS (SELECT dst AS vid, src AS value FROM edges) "
        "SELECT vid, min(value) AS value FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY vid"
    )


def map_reduce(name: str) -> str:
    return f"WITH {_arcs(name)} SELECT CAST(sum(vid % 10) AS BIGINT) AS total FROM verts WHERE vid IN (SELECT src FROM edges)"


def messages(name: str) -> str:
    return f"WITH {_arcs(name)} SELECT dst AS vid, min(src) AS least, count(*) AS n FROM arcs GROUP BY dst"
