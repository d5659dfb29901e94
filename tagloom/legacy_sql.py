"""DuckDB SQL of the older library path: greedy matches, chained blocks, variants, summaries."""

from __future__ import annotations

_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
_FAR = 1 << 62

#: From tags and documents to ``ma``: one step of the recursion a query tag that has candidates.
MATCHES = f"""pr AS MATERIALIZED (SELECT a.g AS query, b.g AS reference FROM (SELECT DISTINCT source AS g FROM documents) a JOIN (SELECT DISTINCT source AS g FROM documents) b ON a.g < b.g),
num AS MATERIALIZED (SELECT genome_id, contig_id, position, enzyme, tag, length(tag) AS len, row_number() OVER (PARTITION BY genome_id ORDER BY contig_id, position, enzyme) AS id FROM tags),
near AS (SELECT query, reference, q.contig_id AS qc, q.position AS qp, q.enzyme AS qe, q.id AS qid, r.contig_id AS rc, r.position AS rp, r.enzyme AS re, r.id AS rid, hamming(substr(q.tag, 1, least(q.len, r.len)), substr(r.tag, 1, least(q.len, r.len))) AS mm, (rpad(q.tag, 32, 'A') <> rpad(r.tag, 32, 'A'))::INT AS differs
  FROM pr JOIN num q ON q.genome_id = query JOIN num r ON r.genome_id = reference WHERE hamming(substr(q.tag, 1, least(q.len, r.len)), substr(r.tag, 1, least(q.len, r.len))) <= 2),
cand AS MATERIALIZED (SELECT query, reference, qc, qp, qe, list({{differs: differs, mm: mm, rc: rc, rp: rp, re: re, id: rid}} ORDER BY rid) AS c, row_number() OVER (PARTITION BY query, reference ORDER BY qid) AS i FROM near GROUP BY query, reference, qc, qp, qe, qid),
gr AS (
  SELECT query, reference, 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS lqc, NULL::BIGINT AS lqp, NULL::BIGINT AS lrc, NULL::BIGINT AS lrp, NULL::VARCHAR AS enzyme, NULL::BIGINT AS qc, NULL::BIGINT AS qp, NULL::BIGINT AS rc, NULL::BIGINT AS rp, NULL::INT AS mm, NULL::BIGINT AS gap, NULL::VARCHAR AS re FROM (SELECT DISTINCT query, reference FROM cand)
  UNION ALL
  SELECT query, reference, i, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.id) END, CASE WHEN b IS NULL THEN lqc ELSE qc END, CASE WHEN b IS NULL THEN lqp ELSE qp END, coalesce(b.rc, lrc), coalesce(b.rp, lrp), CASE WHEN b IS NULL THEN NULL ELSE qe END, qc, qp, b.rc, b.rp, b.mm::INT, CASE WHEN b IS NULL THEN NULL WHEN lqc = qc AND lrc = b.rc THEN b.lead ELSE 0 END, b.re
  FROM (SELECT g.query, g.reference, k.i, g.used, g.lqc, g.lqp, g.lrc, g.lrp, k.qc, k.qp, k.qe,
      list_sort(list_transform(list_filter(k.c, lambda x: NOT list_contains(g.used, x.id)), lambda x: {{differs: x.differs, mm: x.mm, lead: CASE WHEN g.lqc IS NULL THEN 0 WHEN g.lqc = k.qc AND g.lrc = x.rc THEN abs((x.rp - g.lrp) - (k.qp - g.lqp)) ELSE {_FAR} END, id: x.id, rc: x.rc, rp: x.rp, re: x.re}}))[1] AS b
    FROM gr g JOIN cand k ON k.query = g.query AND k.reference = g.reference AND k.i = g.i + 1)),
ma AS MATERIALIZED (SELECT query, reference, enzyme, qc AS q_contig, qp AS q_pos, rc AS r_contig, rp AS r_pos, mm, gap AS gap_diff, re AS r_enzyme, greatest(a.n, b.n) AS len, (a.n + b.n) / 2 AS mean_len
  FROM gr JOIN (SELECT enzyme AS e, max(length(tag)) AS n FROM tags GROUP BY 1) a ON a.e = enzyme JOIN (SELECT enzyme AS e, max(length(tag)) AS n FROM tags GROUP BY 1) b ON b.e = re WHERE enzyme IS NOT NULL)"""

#: From ``ma`` to ``bl`` (blocks) and ``sized`` (matches with the size of the last block that has them).
BLOCKS = """gp AS MATERIALIZED (SELECT query, reference, q_contig, r_contig, list(q_pos ORDER BY q_pos, r_pos) AS q, list(r_pos ORDER BY q_pos, r_pos) AS r, list(q_pos - r_pos ORDER BY q_pos, r_pos) AS d, list(1 - mm / len ORDER BY q_pos, r_pos) AS a, count(*) AS n FROM ma GROUP BY ALL),
dp AS (
  SELECT query, reference, q_contig, r_contig, q, d, n, 0::BIGINT AS i, []::BIGINT[] AS l, []::BIGINT[] AS bef FROM gp
  UNION ALL
  SELECT query, reference, q_contig, r_contig, q, d, n, i + 1, list_append(l, coalesce(list_max(p), 0) + 1), list_append(bef, CASE WHEN list_max(p) > 0 THEN list_position(p, list_max(p)) ELSE 0 END)
  FROM (SELECT *, list_transform(range(1, i + 1), lambda j: CASE WHEN q[j] < q[i + 1] AND abs(d[j] - d[i + 1]) <= 5000 THEN l[j] ELSE 0 END) AS p FROM dp WHERE i < n)),
od AS MATERIALIZED (SELECT query, reference, q_contig, r_contig, n, bef, list_transform(list_sort(list_transform(range(1, n + 1), lambda j: {m: -l[j], j: j})), lambda x: x.j) AS o FROM dp WHERE i = n),
ex AS (
  SELECT query, reference, q_contig, r_contig, n, bef, o, 0::BIGINT AS k, []::BIGINT[] AS used, []::STRUCT(a BIGINT, b BIGINT)[] AS rg FROM od
  UNION ALL
  SELECT query, reference, q_contig, r_contig, n, bef, o, k + 1, CASE WHEN len(p) > 1 THEN list_concat(used, p) ELSE used END, CASE WHEN len(p) > 1 THEN list_append(rg, {a: p[len(p)], b: p[1]}) ELSE rg END
  FROM (SELECT *, CASE WHEN list_contains(used, o[k + 1]) THEN [] ELSE list_reduce([[o[k + 1]]] || list_transform(range(n), lambda x: [0::BIGINT]), lambda h, x: CASE WHEN bef[h[len(h)]] > 0 AND NOT list_contains(used, bef[h[len(h)]]) THEN list_append(h, bef[h[len(h)]]) ELSE h END) END AS p FROM ex WHERE k < n)),
rn AS (SELECT query, reference, q_contig, r_contig, unnest(list_concat(rg, list_transform(list_filter(range(1, n + 1), lambda j: NOT list_contains(used, j)), lambda j: {a: j, b: j}))) AS x FROM ex WHERE k = n),
rk AS MATERIALIZED (SELECT query, reference, q_contig, r_contig, x.a AS a0, x.b AS b0, row_number() OVER (PARTITION BY query, reference, q_contig, r_contig ORDER BY x.a, x.b) - 1 AS block FROM rn),
bl AS MATERIALIZED (SELECT query, reference, q_contig, r_contig, '+' AS orient, block, b0 - a0 + 1 AS n_tags, q[a0] AS q_start, q[b0] AS q_end, list_min(r[a0:b0]) AS r_start, list_max(r[a0:b0]) AS r_end, list_avg(a[a0:b0]) AS block_ani FROM rk JOIN gp USING (query, reference, q_contig, r_contig)),
sized AS (SELECT m.*, size FROM (SELECT *, row_number() OVER (PARTITION BY query, reference, q_contig, r_contig ORDER BY q_pos, r_pos) AS j FROM ma) m JOIN (SELECT query, reference, q_contig, r_contig, j, max_by(b0 - a0 + 1, block) AS size FROM rk, (SELECT unnest(range(1, 100001)) AS j) WHERE j BETWEEN a0 AND b0 GROUP BY ALL) USING (query, reference, q_contig, r_contig, j))"""


def _clusters(role: str, kind: str) -> str:
    side, enzyme = role[0], "enzyme" if role == "query" else "r_enzyme"
    ends = "a, b, 0, 0" if role == "query" else "0, 0, a, b"
    return f"""{side}un AS (SELECT pr.query, pr.reference, t.enzyme, contig_id, position FROM pr JOIN tags t ON genome_id = pr.{role} WHERE NOT EXISTS (SELECT 1 FROM ma m WHERE m.query = pr.query AND m.reference = pr.reference AND m.{enzyme} = t.enzyme AND m.{side}_contig = contig_id AND m.{side}_pos = position)),
{side}nw AS (SELECT *, CASE WHEN position - lag(position) OVER (PARTITION BY query, reference ORDER BY position, contig_id, enzyme) <= 1000 THEN 0 ELSE 1 END AS new FROM {side}un),
{side}cl AS (SELECT *, sum(new) OVER (PARTITION BY query, reference ORDER BY position, contig_id, enzyme ROWS UNBOUNDED PRECEDING) AS cluster FROM {side}nw),
{side}v(query, reference, sv_type, q_start, q_end, r_start, r_end, size, confidence) AS (SELECT query, reference, '{kind}', {ends}, size, 0.6::DOUBLE FROM (SELECT query, reference, cluster, min(position) AS a, max(position) AS b, count(*) * 32 AS size FROM {side}cl GROUP BY ALL))"""


VARIANTS = f"""bp AS (SELECT *, lag(q_end) OVER w AS p_end, lag(r_end) OVER w AS p_r FROM bl WINDOW w AS (PARTITION BY query, reference ORDER BY q_contig, q_start, q_end, r_contig, r_start)),
{_clusters('query', 'insertion')},
{_clusters('reference', 'deletion')},
va AS (SELECT query, reference, 'translocation' AS sv_type, p_end AS q_start, q_start AS q_end, p_r AS r_start, r_start AS r_end, r_start - p_r AS size, 0.7::DOUBLE AS confidence FROM bp WHERE r_start > p_r + 100000 UNION ALL SELECT * FROM qv UNION ALL SELECT * FROM rv)"""

#: From ``ma``, ``bl`` and ``sized`` to ``su``: the summary of each pair.
SUMMARY = f"""per AS (SELECT query, reference, count(*) AS shared, avg(1 - mm / len) AS raw, sum((1 - mm / len) * sqrt(size)) / sum(sqrt(size)) AS weighted FROM sized GROUP BY ALL),
ct AS (SELECT genome_id, contig_id, count(*) AS n FROM tags GROUP BY ALL), gt AS (SELECT genome_id, count(*) AS n FROM tags GROUP BY ALL),
cm AS (SELECT query, reference, q_contig, r_contig, count(*) AS n, avg(mean_len) AS len FROM ma GROUP BY query, reference, q_contig, r_contig QUALIFY row_number() OVER (PARTITION BY query, reference, q_contig ORDER BY count(*) DESC, r_contig) = 1),
mash AS (SELECT query, reference, sum(greatest(0, least(1, 1 + ln(c.n / sqrt(a.n * b.n)) / len)) * c.n) / sum(c.n) AS mash FROM cm c JOIN ct a ON a.genome_id = query AND a.contig_id = q_contig JOIN ct b ON b.genome_id = reference AND b.contig_id = r_contig GROUP BY ALL),
sp AS (SELECT query, reference, q_contig, r_contig, block, n_tags, 'q' AS side, query AS genome_id, q_contig AS contig_id, q_start AS lo, q_end + 1 AS hi FROM bl UNION ALL SELECT query, reference, q_contig, r_contig, block, n_tags, 'r', reference, r_contig, r_start, r_end + 1 FROM bl),
sw AS (SELECT s.* EXCLUDE (genome_id, contig_id, lo, hi), substr(seq, lo + 1, least(hi, length(seq)) - lo) AS w FROM sp s JOIN contigs USING (genome_id, contig_id)),
sk AS (SELECT DISTINCT query, reference, q_contig, r_contig, block, n_tags, side, least(m, {_RC.format('m')}) AS m FROM (SELECT *, substr(w, i + 1, 15) AS m FROM (SELECT *, unnest(range(0, length(w) - 14)) AS i FROM sw WHERE length(w) > 15))),
s2 AS (SELECT query, reference, q_contig, r_contig, block, n_tags, m, max(CASE WHEN side = 'q' THEN 1 ELSE 0 END) AS q, max(CASE WHEN side = 'r' THEN 1 ELSE 0 END) AS r FROM sk GROUP BY ALL),
s3 AS (SELECT query, reference, q_contig, r_contig, block, n_tags, sum(q) AS nq, sum(r) AS nr, sum(q * r) AS shared FROM s2 GROUP BY ALL HAVING sum(q) > 0 AND sum(r) > 0),
km AS (SELECT query, reference, sum(greatest(least(1 + ln(greatest(least(shared / least(nq, nr), 1), 1e-9)) / 15, 1), 0) * n_tags) / sum(n_tags) AS kmer FROM s3 GROUP BY ALL),
s4 AS (SELECT pr.query, pr.reference, coalesce(shared, 0) AS shared, raw, weighted, mash, coalesce(kmer, mash) AS kmer, CASE WHEN a.n > 0 THEN coalesce(shared, 0) / a.n ELSE 0 END AS af_q, CASE WHEN b.n > 0 THEN coalesce(shared, 0) / b.n ELSE 0 END AS af_r
  FROM pr LEFT JOIN per USING (query, reference) LEFT JOIN mash USING (query, reference) LEFT JOIN km USING (query, reference) LEFT JOIN gt a ON a.genome_id = pr.query LEFT JOIN gt b ON b.genome_id = pr.reference),
s5 AS (SELECT *, shared >= 10 AND least(af_q, af_r) >= 0.1 AS ok FROM s4),
su AS (SELECT query, reference, CASE WHEN ok THEN kmer ELSE 0 END AS ani, CASE WHEN ok THEN raw ELSE 0 END AS raw_ani, CASE WHEN ok THEN weighted ELSE 0 END AS weighted_ani, CASE WHEN ok THEN mash ELSE 0 END AS mash_ani, CASE WHEN ok THEN kmer ELSE 0 END AS kmer_ani, af_q AS af_query, af_r AS af_reference,
  CASE WHEN ok THEN (1 - exp(-shared / 100)) * sqrt(least(af_q, af_r)) ELSE 0 END AS confidence, CASE WHEN ok THEN shared ELSE 0 END AS shared_tags FROM s5)"""
