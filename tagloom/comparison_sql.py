"""DuckDB SQL of a whole comparison: the same rules as ``operators.compare``, said in common table expressions."""

from __future__ import annotations

import math

from tagloom.operators import fits
from tagloom.operators.enzymes import DEFAULT_PANEL, get

_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
GROUP = "query, reference, q_contig, r_contig, orient"


def _geometry() -> str:
    rows = []
    for name in DEFAULT_PANEL:
        k, exact, d2, d3 = fits.sites([get(name)])[name]
        c = fits.ways(k, exact, d2, d3, 2)
        rows.append(f"('{name}', {k}, {float(k)!r}::DOUBLE, {k - exact - d2 - d3}, {c[0]!r}::DOUBLE, {c[1]!r}::DOUBLE, {c[2]!r}::DOUBLE, {k - exact - 2 * d2 / 3 - d3 / 3!r}::DOUBLE, {2 * d2 / 3 + float(d3)!r}::DOUBLE)")
    return f"geo AS (SELECT * FROM (VALUES {', '.join(rows)}) g(enzyme, tag_len, k, body_len, c0, c1, c2, wide, kill))"


# --- chains ------------------------------------------------------------------------------------

_COST = "0.0005::DOUBLE * abs((q[i] - q[j]) - (s[i] - s[j])) + 0.05::DOUBLE * log2(abs((q[i] - q[j]) - (s[i] - s[j])) + 1)"


def _chains(n: int, runs: str) -> str:
    """ch<n>: one row of the recursion a step: an anchor is added to the programme, or the best path is taken and its anchors die."""
    keys = f"{GROUP}, q, r, s, k, lim, n"
    return f"""st{n} AS (
  SELECT {keys}, list_transform(q, lambda x: true) AS alive, 1::BIGINT AS i, []::DOUBLE[] AS score, []::BIGINT[][] AS path, NULL::BIGINT[] AS found, true AS go FROM {runs}
  UNION ALL
  SELECT {keys}, CASE WHEN i <= n THEN alive ELSE list_transform(range(1, n + 1), lambda x: alive[x] AND NOT list_contains(top, x)) END, CASE WHEN i <= n THEN i + 1 ELSE 1 END,
    CASE WHEN i <= n THEN list_append(score, CASE WHEN NOT alive[i] THEN '-inf'::DOUBLE WHEN best > 1 THEN best ELSE 1::DOUBLE END) ELSE [] END,
    CASE WHEN i <= n THEN list_append(path, CASE WHEN alive[i] AND best > 1 THEN list_append(path[origin], i) ELSE [i] END) ELSE [] END,
    CASE WHEN i > n AND high >= 4 THEN top END, i <= n OR high >= 4
  FROM (SELECT *, list_max(prev) AS best, greatest(1, i - 60) - 1 + list_position(prev, list_max(prev)) AS origin, list_max(score) AS high, path[list_position(score, list_max(score))] AS top
    FROM (SELECT *, list_transform(range(greatest(1, i - 60), i), lambda j: CASE WHEN alive[j] AND q[i] > q[j] AND s[i] > s[j] AND q[i] - q[j] <= 50000 AND s[i] - s[j] <= 50000 AND k[i] - k[j] - 1 <= lim THEN score[j] + 1 - ({_COST}) ELSE '-inf'::DOUBLE END) AS prev FROM st{n} WHERE go))),
free{n} AS (SELECT {GROUP}, list_transform(found, lambda x: q[x]) AS cq, list_transform(found, lambda x: r[x]) AS cr FROM st{n} WHERE len(found) >= 4)"""


def _number(name: str, rows: str) -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY query, reference ORDER BY len(cq) DESC, q_contig, cq[1], r_contig, cr[1], orient) - 1 AS chain_id, len(cq)::BIGINT AS n_anchors FROM {rows})"


def _tested(n: int, chains: str, tails: str) -> str:
    """str<n>: what the tags in chains and on rescued contigs are found with. tails has (query, reference, tail)."""
    at = "floor(cr[j] + (cr[j + 1] - cr[j]) * (position - cq[j]) / (cq[j + 1] - cq[j]))::BIGINT"
    line = "floor(r[j] + (r[j + 1] - r[j]) * (position - q[j]) / (q[j + 1] - q[j]))::BIGINT"
    return f"""cl{n} AS (SELECT query, reference, q_contig, enzyme, position, tag, r_contig, orient, spot FROM (
  SELECT *, {at} AS spot, row_number() OVER (PARTITION BY query, reference, q_contig, enzyme, position ORDER BY chain_id, j) AS nth
  FROM (SELECT *, unnest(range(1, n_anchors)) AS j FROM {chains}) c JOIN tags t ON genome_id = query AND contig_id = q_contig AND position >= cq[j] AND position <= cq[j + 1]) WHERE nth = 1),
rs{n} AS (SELECT * FROM (
  SELECT b.*, t.enzyme, t.position, t.tag, tail, CASE WHEN t.position < q[1] THEN -1 WHEN t.position > q[n] THEN 1 ELSE 0 END AS side,
    CASE WHEN t.position < q[1] THEN q[1] - t.position WHEN t.position > q[n] THEN t.position - q[n] ELSE 0 END AS dist,
    CASE WHEN t.position < q[1] THEN greatest(r[1] - sign * (q[1] - t.position), 0) WHEN t.position > q[n] THEN greatest(r[n] + sign * (t.position - q[n]), 0) WHEN t.position = q[n] THEN r[n]
      ELSE (SELECT {line} FROM (SELECT len(list_filter(q, lambda x: x <= t.position)) AS j)) END AS spot
  FROM bases b JOIN tags t ON t.genome_id = query AND t.contig_id = q_contig JOIN {tails} USING (query, reference)
  WHERE NOT EXISTS (SELECT 1 FROM cl{n} c WHERE c.query = b.query AND c.reference = b.reference AND c.q_contig = b.q_contig AND c.enzyme = t.enzyme AND c.position = t.position))
  WHERE side = 0 OR (side < 0 AND left_ <= tail AND dist <= left_) OR (side > 0 AND right_ <= tail AND dist <= right_)),
ts{n} AS (SELECT query, reference, q_contig, enzyme, position, tag, r_contig, orient, spot FROM cl{n} UNION ALL SELECT query, reference, q_contig, enzyme, position, tag, r_contig, orient, spot FROM rs{n}),
nr{n} AS (SELECT o.query, o.reference, o.q_contig, o.enzyme, o.position, min(hamming(CASE o.orient WHEN '-' THEN {_RC.format('o.tag')} ELSE o.tag END, t.tag)) AS mm
  FROM ts{n} o LEFT JOIN tags t ON t.genome_id = o.reference AND t.contig_id = o.r_contig AND t.enzyme = o.enzyme AND abs(t.position - o.spot) <= 3000 GROUP BY ALL),
str{n} AS (SELECT query, reference, enzyme, count(CASE WHEN mm = 0 THEN 1 END)::DOUBLE AS h0, count(CASE WHEN mm = 1 THEN 1 END)::DOUBLE AS h1, count(CASE WHEN mm = 2 THEN 1 END)::DOUBLE AS h2, count(CASE WHEN mm IS NULL OR mm > 2 THEN 1 END)::DOUBLE AS miss FROM nr{n} GROUP BY ALL)"""


# --- fits: folds over lists of strata, each step a list_reduce -----------------------------------


def _arrays(name: str, strata: str) -> str:
    return f"""{name} AS (SELECT query, reference, list({{enzyme: enzyme, k: k, c0: c0, c1: c1, c2: c2, wide: wide, kill: kill, h0: h0, h1: h1, h2: h2, miss: miss, found: h0 + h1 + h2, total: h0 + h1 + h2 + miss}} ORDER BY enzyme) AS s
  FROM {strata} JOIN geo USING (enzyme) WHERE h0 + h1 + h2 + miss > 0 GROUP BY ALL)"""


def _sum(term: str) -> str:
    return f"list_sum(list_transform(s, lambda t: {term}))"


def _climb(lo: float, hi: float, rises) -> str:
    y = "(x + w)"
    return f"list_reduce([{lo!r}::DOUBLE] || list_transform(range(1, {fits.STEPS + 1}), lambda i: {hi - lo!r}::DOUBLE / pow(2, i)), lambda x, w: CASE WHEN {rises(y)} THEN {y} ELSE x END)"


def _p(a: str) -> tuple[str, str, str]:
    b = f"pow({a}, t.k - 2)"
    return f"(t.c0 * {a} * {a} * {b})", f"(t.c1 * (1 - {a}) * {a} * {b})", f"(t.c2 * (1 - {a}) * (1 - {a}) * {b})"


def _weighted(p: tuple[str, str, str], a: str) -> str:
    return "(" + " + ".join(f"{x} * ((t.k - {m}) / {a} - {m} / (1 - {a}))" for m, x in enumerate(p)) + ")"


_H = ("t.h0", "t.h1", "t.h2")


def _all(p: tuple[str, str, str]) -> str:
    return "(" + " + ".join(p) + ")"


def _slope(a: str) -> str:
    return _sum(f"{_weighted(_H, a)} - CASE WHEN t.miss > 0 THEN t.miss * {_weighted(_p(a), a)} / greatest(1 - {_all(_p(a))}, 1e-300::DOUBLE) ELSE 0 END")


def _expected(a: str) -> str:
    return _sum(f"t.total * {_all(_p(a))}")


UNIFORM = _climb(fits.LOW, fits.HIGH, lambda a: f"{_slope(a)} > 0")


def _retention(a: str) -> str:
    return f"({_expected(a)} / {_sum('t.total')})"


def _log1m(z: str) -> str:
    """ln(1 - z) of a small z, exact to the last places."""
    return f"(CASE WHEN 1 - {z} = 1 THEN -{z} ELSE ln(1 - {z}) * {z} / (1 - (1 - {z})) END)"


def _std_err(a: str) -> str:
    lost = lambda x: f"greatest(1 - {_all(_p(x))}, 1e-300::DOUBLE)"
    found = " + ".join(f"{h} * ((t.k - {m}) * {_log1m(f'((e / {a}) * (e / {a}))')} + {m} * {_log1m(f'((e / (1 - {a})) * (e / (1 - {a})))')})" for m, h in enumerate(_H))
    bend = _sum(f"-({found}) - CASE WHEN t.miss > 0 THEN t.miss * ln({lost(f'({a} + e)')} / {lost(a)} * ({lost(f'({a} - e)')} / {lost(a)})) ELSE 0 END")
    return f"(SELECT CASE WHEN b > 0 THEN 1 / sqrt(b) ELSE 'NaN'::DOUBLE END FROM (SELECT {bend} / (e * e) AS b FROM (SELECT least(1e-5::DOUBLE, greatest(1 - {a}, 1e-9::DOUBLE) / 4) AS e)))"


LOSS = f"CASE WHEN {_sum('t.found')} > 0 THEN {_climb(fits.LOW, fits.HIGH, lambda a: _expected(a) + ' < ' + _sum('t.found'))} ELSE 'NaN'::DOUBLE END"
HISTOGRAM = f"CASE WHEN {_sum('t.found')} > 0 THEN " + _climb(fits.LOW, fits.HIGH, lambda a: _sum(f"CASE WHEN t.found > 0 THEN {_weighted(_H, a)} - t.found * {_weighted(_p(a), a)} / {_all(_p(a))} ELSE 0 END") + " > 0") + " ELSE 'NaN'::DOUBLE END"


def _gamma(d: str, alpha: str) -> tuple[str, str, str]:
    p0 = f"exp(-{alpha} * (ln(1 + {d} * t.k / {alpha}) + ln(1 + {d} * t.kill / {alpha})))"
    x = f"(t.wide * {d} / ({alpha} + {d} * t.k))"
    return p0, f"({p0} * {alpha} * {x})", f"({p0} * {alpha} * {x} * ({alpha} + 1) / 2 * {x})"


def _rate(alpha: str) -> str:
    def weighted(p: tuple[str, str, str], d: str) -> str:
        return "(" + " + ".join(f"{x} * ({m} / {d} - ({alpha} + {m}) * t.k / ({alpha} + {d} * t.k) - {alpha} * t.kill / ({alpha} + {d} * t.kill))" for m, x in enumerate(p)) + ")"

    return _climb(fits.RATE_LOW, fits.RATE_HIGH, lambda d: _sum(f"{weighted(_H, d)} - CASE WHEN t.miss > 0 THEN t.miss * {weighted(_gamma(d, alpha), d)} / greatest(1 - {_all(_gamma(d, alpha))}, 1e-300::DOUBLE) ELSE 0 END") + " > 0")


def _gamma_cost(d: str, alpha: str) -> str:
    p = _gamma(d, alpha)
    terms = " - ".join(f"CASE WHEN {h} > 0 THEN {h} * ln(greatest({x}, 1e-300::DOUBLE)) ELSE 0 END" for h, x in zip(_H, p, strict=True))
    return _sum(f"CASE WHEN t.miss > 0 THEN -t.miss * ln(greatest(1 - {_all(p)}, 1e-300::DOUBLE)) ELSE 0 END - {terms}")


def _scan(name: str, source: str, logs: str) -> str:
    """<name>: the best of some log shapes of each row of source (key, s)."""
    return f"""{name}1 AS MATERIALIZED (SELECT key, s, i, lg, exp(lg) AS al FROM (SELECT key, s, unnest(range(len(l))) AS i, unnest(l) AS lg FROM (SELECT key, s, {logs} AS l FROM {source}))),
{name}2 AS MATERIALIZED (SELECT *, {_rate('al')} AS d FROM {name}1),
{name}3 AS MATERIALIZED (SELECT key, lg, d, al, {_gamma_cost('d', 'al')} AS cost, i FROM {name}2),
{name} AS MATERIALIZED (SELECT * FROM {name}3 QUALIFY row_number() OVER (PARTITION BY key ORDER BY cost, i) = 1)"""


def heterogeneous(name: str, source: str) -> str:
    """<name> (key, ani, shape) of source (key, s, uniform)."""
    lo, hi = math.log(fits.SHAPE_LOW), math.log(fits.SHAPE_HIGH)
    coarse = "[" + ", ".join(f"{lo + (hi - lo) * i / fits.COARSE!r}::DOUBLE" for i in range(fits.COARSE + 1)) + "]"
    fine = f"list_transform(range({fits.FINE + 1}), lambda i: lg - {fits.REACH!r}::DOUBLE + {2 * fits.REACH!r}::DOUBLE * i / {fits.FINE})"
    flat = f"{fits.UNIFORM_SHAPE!r}::DOUBLE"
    return f"""{_scan(name + '_c', source, coarse)},
{name}_n AS (SELECT f.key, f.s, lg FROM {source} f JOIN {name}_c USING (key)),
{_scan(name + '_f', name + '_n', fine)},
{name}_d AS MATERIALIZED (SELECT key, s, {_rate(flat)} AS d FROM {source}),
{name}_u AS MATERIALIZED (SELECT key, {_gamma_cost('d', flat)} AS flat FROM {name}_d),
{name} AS (SELECT f.key, CASE WHEN 2 * (flat - cost) > {fits.WORTH} AND al < {0.99 * fits.SHAPE_HIGH!r}::DOUBLE THEN pow(1 + d / al, -al) ELSE f.uniform END AS ani, CASE WHEN 2 * (flat - cost) > {fits.WORTH} AND al < {0.99 * fits.SHAPE_HIGH!r}::DOUBLE THEN al ELSE 'inf'::DOUBLE END AS shape
  FROM {source} f JOIN {name}_f USING (key) JOIN {name}_u USING (key))"""


def upper(name: str, source: str) -> str:
    """<name> (query, reference, upper) of source (query, reference, s): the binomial bound of the share found, then its identity."""
    tail = "list_sum(list_transform(range(0, found::BIGINT + 1), lambda i: exp(lgamma(total + 1) - lgamma(i + 1.0) - lgamma(total - i + 1.0) + i * ln(least(x + w, 1 - 1.1102230246251565e-16::DOUBLE)) + (total - i) * ln(1 - least(x + w, 1 - 1.1102230246251565e-16::DOUBLE)))))"
    fold = f"list_reduce([found / total] || list_transform(range(1, 61), lambda i: (1 - found / total) / pow(2, i)), lambda x, w: CASE WHEN x + w < 1 AND {tail} > 0.05 THEN x + w ELSE x END)"
    at = lambda a: _retention(f"{a!r}::DOUBLE")
    return f"""{name}1 AS MATERIALIZED (SELECT *, {_sum('t.found')} AS found, {_sum('t.total')} AS total FROM {source}),
{name}2 AS MATERIALIZED (SELECT *, CASE WHEN found >= total THEN 1.0 WHEN found = 0 THEN 1 - pow(0.05::DOUBLE, 1 / total) ELSE {fold} END AS share FROM {name}1),
{name} AS (SELECT query, reference, CASE WHEN share >= 1 THEN 1.0 WHEN {at(fits.LOW)} >= share THEN 0.5 WHEN {at(fits.HIGH)} <= share THEN 1.0 ELSE {_climb(fits.LOW, fits.HIGH, lambda a: _retention(a) + ' < share')} END AS upper FROM {name}2)"""


# --- the whole --------------------------------------------------------------------------------------

_STEP = "least(list_sort(list_transform(range(2, len({0}) + 1), lambda i: abs({0}[i] - {0}[i - 1])))[(len({0}) - 1) // 2 + 1] // 2, 10000)"


def chains_sql() -> str:
    """Expressions from tags, pairs and anchors on up to ``ch`` (chains), ``str2`` (strata), ``rs2`` (rescued) and ``sp`` (spans), of the pairs in ``sel``."""
    order = "list_position(['" + "', '".join(DEFAULT_PANEL) + "'], enzyme)"
    far = lambda edge, way: f"min(CASE WHEN a.r_pos {way} u.r[{edge}] THEN abs(a.r_pos - u.r[{edge}]) END)"
    return ",\n".join([
        _geometry(),
        f"rk AS MATERIALIZED (SELECT genome_id, contig_id, enzyme, position, row_number() OVER (PARTITION BY genome_id, contig_id ORDER BY position, {order}) - 1 AS k FROM tags)",
        "anc AS MATERIALIZED (SELECT a.*, k, CASE orient WHEN '-' THEN -r_pos ELSE r_pos END AS s FROM anchors a JOIN sel USING (query, reference) JOIN rk ON rk.genome_id = query AND rk.contig_id = q_contig AND rk.enzyme = a.enzyme AND rk.position = q_pos)",
        f"runs1 AS MATERIALIZED (SELECT {GROUP}, list(q_pos ORDER BY q_pos, s) AS q, list(r_pos ORDER BY q_pos, s) AS r, list(s ORDER BY q_pos, s) AS s, list(k ORDER BY q_pos, s) AS k, 'inf'::DOUBLE AS lim, count(*) AS n FROM anc GROUP BY ALL HAVING n >= 4)",
        _chains(1, "runs1"), _number("ch1", "free1"),
        "short AS (SELECT genome_id, contig_id FROM tags GROUP BY ALL HAVING count(*) < 32)",
        f"ug AS (SELECT {GROUP}, count(*) AS n, sum(mm) AS mm, list(q_pos ORDER BY q_pos, s) AS q, list(r_pos ORDER BY q_pos, s) AS r, list(s ORDER BY q_pos, s) AS s FROM anc JOIN short ON genome_id = query AND contig_id = q_contig WHERE uniq GROUP BY ALL HAVING count(*) >= 2 AND min(mm) <= 1)",
        "ub AS (SELECT * FROM ug QUALIFY row_number() OVER (PARTITION BY query, reference, q_contig ORDER BY n DESC, mm, r_contig, orient) = 1)",
        "uc AS (SELECT *, CASE orient WHEN '-' THEN -1 ELSE 1 END AS sign FROM ub WHERE len(list_filter(range(2, n + 1), lambda i: s[i] <= s[i - 1] OR abs((q[i] - s[i]) - (q[i - 1] - s[i - 1])) > 50000)) = 0)",
        f"bases AS MATERIALIZED (SELECT u.query, u.reference, u.q_contig, u.r_contig, u.orient, u.n, u.q, u.r, u.sign, CASE u.orient WHEN '-' THEN {far('1', '>')} ELSE {far('1', '<')} END AS left_, CASE u.orient WHEN '-' THEN {far('u.n', '<')} ELSE {far('u.n', '>')} END AS right_ FROM uc u JOIN anc a ON a.query = u.query AND a.reference = u.reference AND a.r_contig = u.r_contig GROUP BY u.query, u.reference, u.q_contig, u.r_contig, u.orient, u.n, u.q, u.r, u.sign)",
        "tail1 AS (SELECT DISTINCT query, reference, 'inf'::DOUBLE AS tail FROM ch1)",
        _tested(1, "ch1", "tail1"), _arrays("ar1", "str1"),
        f"fit1 AS MATERIALIZED (SELECT query, reference, s, {UNIFORM} AS a FROM ar1)",
        f"lim AS MATERIALIZED (SELECT query, reference, greatest(5, ceil(ln(1e-6::DOUBLE) / ln(1 - p))) AS max_skip FROM (SELECT query, reference, {_retention('a')} AS p FROM fit1) WHERE p > 0 AND p < 1)",
        f"runs2 AS MATERIALIZED (SELECT {GROUP}, q, r, s, k, max_skip AS lim, n FROM runs1 JOIN lim USING (query, reference))",
        _chains(2, "runs2"),
        "both2 AS (SELECT * FROM free2 UNION ALL SELECT * FROM free1 WHERE NOT EXISTS (SELECT 1 FROM free2 f WHERE f.query = free1.query AND f.reference = free1.reference))", _number("ch", "both2"),
        "spacing AS (SELECT genome_id, bp / n AS spacing FROM (SELECT genome_id, sum(length(seq)) AS bp FROM contigs GROUP BY ALL) JOIN (SELECT genome_id, count(*) AS n FROM tags GROUP BY ALL) USING (genome_id))",
        "tail2 AS (SELECT c.query, c.reference, coalesce((max_skip + 1) * spacing, 'inf'::DOUBLE) AS tail FROM (SELECT DISTINCT query, reference FROM ch) c LEFT JOIN (SELECT DISTINCT query, reference, max_skip FROM free2 JOIN lim USING (query, reference)) f USING (query, reference) LEFT JOIN spacing ON genome_id = c.query)",
        _tested(2, "ch", "tail2"),
        "len AS (SELECT genome_id, contig_id, length(seq)::BIGINT AS bp FROM contigs)",
        f"sp AS (SELECT query, reference, chain_id, q_contig, r_contig, orient, n_anchors, cq, cr, greatest(list_min(cq) - {_STEP.format('cq')}, 0) AS q_start, least(list_max(cq) + {_STEP.format('cq')}, a.bp) AS q_end, greatest(list_min(cr) - {_STEP.format('cr')}, 0) AS r_start, least(list_max(cr) + {_STEP.format('cr')}, b.bp) AS r_end, a.bp AS q_bp, b.bp AS r_bp FROM ch JOIN len a ON a.genome_id = query AND a.contig_id = q_contig JOIN len b ON b.genome_id = reference AND b.contig_id = r_contig)",
    ])


def _union(side: str) -> str:
    a, b, w = f"{side}_start", f"{side}_end", f"OVER (PARTITION BY query, reference, {side}_contig ORDER BY {side}_start, {side}_end"
    return f"""{side}1 AS (SELECT *, max({b}) {w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM cover),
{side}2 AS (SELECT *, sum(CASE WHEN m IS NULL OR {a} > m THEN 1 ELSE 0 END) {w} ROWS UNBOUNDED PRECEDING) AS island FROM {side}1),
{side}3 AS (SELECT query, reference, sum(bp) AS bp FROM (SELECT query, reference, {side}_contig, island, max({b}) - min({a}) AS bp FROM {side}2 GROUP BY ALL) GROUP BY ALL)"""


def results_sql() -> str:
    """Expressions from ``chains_sql`` on up to ``res``: one row a pair in ``sel``, with unrounded estimates."""
    nan = "'NaN'::DOUBLE"
    rescue = f"""rsp AS (SELECT query, reference, q_contig, r_contig, orient, q, r, max(CASE WHEN side = -1 THEN dist ELSE 0 END) AS lo, max(CASE WHEN side = 1 THEN dist ELSE 0 END) AS hi FROM rs2 GROUP BY ALL),
rso AS (SELECT query, reference, q_contig, r_contig, greatest(q[1] - lo - {_STEP.format('q')}, 0) AS q_start, least(q[len(q)] + hi + {_STEP.format('q')}, a.bp) AS q_end,
  greatest(greatest(list_min(r) - CASE orient WHEN '-' THEN hi ELSE lo END, 0) - {_STEP.format('r')}, 0) AS r_start, least(list_max(r) + CASE orient WHEN '-' THEN lo ELSE hi END + {_STEP.format('r')}, b.bp) AS r_end
  FROM rsp JOIN len a ON a.genome_id = query AND a.contig_id = q_contig JOIN len b ON b.genome_id = reference AND b.contig_id = r_contig),
cover AS (SELECT query, reference, q_contig, r_contig, q_start, q_end, r_start, r_end FROM sp UNION ALL SELECT * FROM rso)"""
    return ",\n".join([
        rescue, _union("q"), _union("r"), "whole AS (SELECT genome_id, sum(bp) AS bp FROM len GROUP BY ALL)",
        _arrays("ar2", "str2"),
        f"fit2 AS MATERIALIZED (SELECT query, reference, query || '|' || reference AS key, s, {UNIFORM} AS uniform FROM ar2)",
        f"fit3 AS MATERIALIZED (SELECT query, reference, key, s, uniform, {_std_err('uniform')} AS std_err, {LOSS} AS loss, {HISTOGRAM} AS hist, {_retention('uniform')} AS kept, {_sum('t.total')}::BIGINT AS n_tags FROM fit2)",
        heterogeneous("het", "fit2"), upper("up", "ar2"),
        "loose AS (SELECT sel.* FROM sel LEFT JOIN (SELECT DISTINCT query, reference, 1 AS got FROM ch) c USING (query, reference) WHERE got IS NULL)",
        "rawt AS (SELECT genome_id AS query, enzyme, count(*) AS total FROM rare GROUP BY ALL)",
        "rawf AS (SELECT query, reference, enzyme, count(DISTINCT (q_contig, q_pos)) AS found FROM anc GROUP BY ALL)",
        "raws AS (SELECT l.query, l.reference, t.enzyme, coalesce(found, 0)::DOUBLE AS h0, 0::DOUBLE AS h1, 0::DOUBLE AS h2, (total - coalesce(found, 0))::DOUBLE AS miss FROM loose l JOIN rawt t USING (query) LEFT JOIN rawf f ON f.query = l.query AND f.reference = l.reference AND f.enzyme = t.enzyme)",
        _arrays("rawa", "raws"), upper("rawu", "rawa"),
        f"en1 AS MATERIALIZED (SELECT query, reference, x.enzyme AS enzyme, [x] AS s FROM (SELECT query, reference, unnest(s) AS x FROM ar2) WHERE x.found > 0), en2 AS MATERIALIZED (SELECT *, {UNIFORM} AS ani FROM en1), en AS MATERIALIZED (SELECT * FROM (SELECT query, reference, enzyme, ani, {_std_err('ani')} AS se FROM en2) WHERE isfinite(se) AND se > 0)",
        f"ag1 AS (SELECT query, reference, count(*) AS n, sum(ani / (se * se)) / sum(1 / (se * se)) AS mean, max(ani) - min(ani) AS spread FROM en GROUP BY ALL), ag AS (SELECT query, reference, any_value(spread) AS spread, CASE WHEN any_value(n) > 1 THEN sum((ani - mean) * (ani - mean) / (se * se)) / (any_value(n) - 1) ELSE {nan} END AS chi2 FROM en JOIN ag1 USING (query, reference) GROUP BY ALL)",
        "cs AS (SELECT query, reference, count(*) AS blocks, sum(n_anchors)::BIGINT AS inside, count(DISTINCT q_contig) AS contigs, max(n_anchors) AS most, avg(n_anchors) AS mean FROM ch GROUP BY ALL), ca AS (SELECT query, reference, count(*) AS n_anchors, count(DISTINCT q_contig) AS anchored FROM anc GROUP BY ALL)",
        f"""res AS (SELECT sel.query, sel.reference, coalesce(h.ani, {nan}) AS het, coalesce(uniform, {nan}) AS uniform, coalesce(std_err, {nan}) AS std_err, coalesce(loss, {nan}) AS loss, coalesce(hist, {nan}) AS hist, coalesce(kept, {nan}) AS kept, coalesce(shape, {nan}) AS shape, coalesce(n_tags, 0) AS n_tags,
  coalesce(up.upper, rawu.upper, {nan}) AS upper, coalesce(spread, 0) AS spread, coalesce(chi2, {nan}) AS chi2, coalesce(q3.bp / a.bp, 0) AS af_query, coalesce(r3.bp / b.bp, 0) AS af_reference, coalesce(n_anchors, 0) AS n_anchors, coalesce(blocks, 0) AS blocks,
  coalesce(CASE WHEN inside > contigs THEN (inside - blocks) / (inside - contigs) ELSE 0 END, 0) AS score, coalesce(blocks - contigs, 0) AS breaks, coalesce(n_anchors - anchored - (inside - blocks), 0) AS unconserved, coalesce(most, 0) AS most, coalesce(mean, 0) AS mean,
  coalesce(isfinite(loss) AND isfinite(hist) AND abs(loss - hist) > 0.05 + 1e-12, false) AS fallback
  FROM sel LEFT JOIN fit3 USING (query, reference) LEFT JOIN het h ON h.key = sel.query || '|' || sel.reference LEFT JOIN up USING (query, reference) LEFT JOIN rawu USING (query, reference) LEFT JOIN ag USING (query, reference) LEFT JOIN q3 USING (query, reference) LEFT JOIN r3 USING (query, reference) LEFT JOIN cs USING (query, reference) LEFT JOIN ca USING (query, reference) LEFT JOIN whole a ON a.genome_id = sel.query LEFT JOIN whole b ON b.genome_id = sel.reference)""",
        """flagged AS (SELECT *, CASE WHEN fallback THEN uniform ELSE het END AS gated, CASE WHEN isnan(kept) OR kept < 0.2 THEN 'BELOW_DETECTION' WHEN blocks = 0 OR fallback OR unconserved / greatest(n_anchors, 1) > 0.5 THEN 'INCONSISTENT' ELSE 'ok' END AS flag FROM res)""",
    ])


def pct(x: str, n: int = 4) -> str:
    return f"round({x} * 100, {n})"


GATE = "CASE WHEN isnan(gated) THEN 'none' WHEN fallback THEN 'uniform_fallback' WHEN isfinite(shape) THEN 'gamma' ELSE 'uniform' END"
_TAIL = f"{pct('gated')} AS ani_gated, {GATE} AS gate, {pct('upper')} AS ani_upper95, flag"
_HEAD = f"query, reference, {pct('het')} AS ani, {pct('uniform')} AS ani_uniform, round(af_query, 4) AS af_query, round(af_reference, 4) AS af_reference, {pct('std_err')} AS std_err"
_SYNTENY = "blocks AS synteny_blocks, round(score, 4)::DOUBLE AS synteny_score, breaks AS breakpoint_count"
ROWS = f"SELECT {_HEAD}, {_SYNTENY}, {_TAIL} FROM flagged"


def verbose_rows(calibrated: str) -> str:
    """The rows with all columns; calibrated: an expression of the calibration over ``flagged``."""
    usable = "NOT isnan(uniform) AND flag <> 'BELOW_DETECTION' AND blocks > 0 AND n_anchors > 0"
    return f"""SELECT {_HEAD}, round(CASE WHEN {usable} THEN {calibrated} ELSE 'NaN'::DOUBLE END, 4) AS ani_cal, {_SYNTENY}, round(shape, 4) AS het_shape, round(kept, 4) AS retention, {pct('loss')} AS ani_from_loss, {pct('hist')} AS ani_from_hist, {pct('spread')} AS enzyme_spread, round(chi2, 3) AS enzyme_chi2,
  n_anchors, blocks AS n_chains, n_tags, most AS max_block_anchors, round(mean, 2) AS mean_block_anchors, {_TAIL} FROM flagged"""
