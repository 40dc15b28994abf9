"""DuckDB SQL of the operators' queries that SQL can express on the whole tables."""

from __future__ import annotations

from .urls import ADDRESS, LIMIT, LONG_SUFFIXES, RULES, STRENGTH, Z

OP3 = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n) END AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to, '2024-03-01T00:00:00Z' AS warc_date FROM m"""

OP5 = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT x.a, x.b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2) x
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY 1), k AS (SELECT a, count(*) AS links FROM l GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, coalesce(links, 0) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id LEFT JOIN k ON k.a = d.doc_id"""

_ORDERED = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))


def _rule(value: int) -> str:
    cases = []
    for rule in _ORDERED:
        name, _, rest = rule[0].partition("/")
        cases.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN '{rule[value]}'")
    return "CASE " + " ".join(cases) + " END"


def _list(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _level(name: str, keys: str, source: str) -> str:
    """Counts of a level, and the prior strength that their spread asks for."""
    return f"""{name} AS (SELECT {keys}, sum(n) AS n, sum(bad) AS bad FROM {source} GROUP BY ALL),
{name}_m AS (SELECT sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, count(*)::DOUBLE AS k, sum(n::DOUBLE * n) AS nn, sum(bad::DOUBLE * bad / n) AS bb, sum(bad) / nullif(sum(n), 0) AS rate FROM {name}),
{name}_r AS (SELECT (bb - n * rate * rate - rate * (1 - rate) * (k - 1)) / nullif(rate * (1 - rate) * (n - nn / nullif(n, 0) - (k - 1)), 0) AS rho FROM {name}_m),
{name}_s AS (SELECT coalesce(max(CASE WHEN rho > 0 THEN greatest({STRENGTH[0]}::DOUBLE, least({STRENGTH[1]}::DOUBLE, 1 / rho - 1)) END), {STRENGTH[1]}::DOUBLE) AS s FROM {name}_r)"""


def _low(mean: str, n: str, s: str) -> str:
    return f"({mean}) - {Z}::DOUBLE * sqrt(({mean}) * (1 - ({mean})) / ({n} + {s} + 1))"


OP6 = rf"""WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
dn AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '\.$', '') AS name FROM p),
dm AS (SELECT *, CASE WHEN regexp_matches(name, '{ADDRESS}') THEN [name] ELSE string_split(name, '.') END AS parts FROM dn),
dl AS (SELECT *, array_to_string(parts[-2:], '.') AS two, array_to_string(parts[-2:], '.') IN ({_list(LONG_SUFFIXES)}) AS long FROM dm),
x AS (SELECT page_id, host, path, CASE WHEN long THEN array_to_string(parts[-3:], '.') ELSE two END AS domain, CASE WHEN long THEN two ELSE parts[-1] END AS suffix FROM dl),
o AS (SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY 1),
l AS (SELECT host, domain, suffix, 1 AS n, bad FROM x JOIN o USING (page_id) WHERE bad IS NOT NULL),
{_level("hs", "host, domain, suffix", "l")}, {_level("ds", "domain, suffix", "hs")}, {_level("ss", "suffix", "ds")},
g AS (SELECT coalesce(sum(n), 0)::DOUBLE AS n, (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1) AS base FROM ss),
t1 AS (SELECT suffix, ss.n, (ss.bad + s * base) / (ss.n + s) AS mean, s FROM ss, g, ss_s),
t2 AS (SELECT domain, suffix, ds.n, (ds.bad + ds_s.s * t1.mean) / (ds.n + ds_s.s) AS mean, ds_s.s AS s FROM ds JOIN t1 USING (suffix), ds_s),
t3 AS (SELECT host, hs.n, (hs.bad + hs_s.s * t2.mean) / (hs.n + hs_s.s) AS mean, hs_s.s AS s FROM hs JOIN t2 USING (domain, suffix), hs_s),
low AS (SELECT x.*, coalesce({_low("t3.mean", "t3.n", "t3.s")}, {_low("t2.mean", "t2.n", "t2.s")}, {_low("t1.mean", "t1.n", "t1.s")}, base - {Z}::DOUBLE * sqrt(base * (1 - base) / (g.n + 2))) AS low
  FROM x LEFT JOIN t3 USING (host) LEFT JOIN t2 ON t2.domain = x.domain AND t2.suffix = x.suffix LEFT JOIN t1 ON t1.suffix = x.suffix, g)
SELECT page_id, host, path, {_rule(0)} AS rule, coalesce({_rule(1)}, CASE WHEN low > {LIMIT}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, round(low, 9) AS bad_rate_low FROM low"""

OP7 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""

OP11 = r"""WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS LAST) = 1 AS kept, h AS text_sha256 FROM t WINDOW g AS (PARTITION BY h)"""

#: Levels that the manifest's SQL spells out: 16**5 rows of a source, 16**3 sources.
LEAF_LEVELS, SOURCE_LEVELS = 5, 3


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, depth: int) -> str:
    """From {name}0 (g, p, n, node): nodes {name}k of each level and the texts {name}rk of its runs; trees of one node stay as they are."""
    out = []
    for k in range(depth):
        out.append(f"{name}r{k} AS (SELECT g, p // 16 AS r, string_agg(node, '' ORDER BY p) AS run FROM {name}{k} WHERE n > 1 GROUP BY 1, 2)")
        out.append(f"{name}{k + 1} AS (SELECT g, p // 16 AS p, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(string_agg(node, '' ORDER BY p)) ELSE max(node) END AS node FROM {name}{k} GROUP BY g, p // 16, n)")
    return ",\n".join(out)


def _fold(name: str, depth: int, begun: str, ended: str) -> str:
    """From ``begun`` (g, p, proof, fold, more) up the tree to ``ended``: siblings are what the run's text has before and behind the own node."""
    out, last = [], begun
    for k in range(depth):
        l, r = f"coalesce(substr(run, 1, 64 * (p // {16**k} % 16)), '')", f"coalesce(substr(run, 64 * (p // {16**k} % 16) + 65), '')"
        now = ended if k == depth - 1 else f"{ended}{k}"
        out.append(f"{now} AS (SELECT x.* REPLACE (proof || {l} || {r} AS proof, CASE WHEN run IS NULL THEN fold ELSE sha256({l} || fold || {r}) END AS fold) FROM {last} x LEFT JOIN {name}r{k} y ON x.g IS NOT DISTINCT FROM y.g AND x.p // {16 ** (k + 1)} = y.r)")
        last = now
    return ",\n".join(out)


OP12 = f"""WITH d AS (SELECT *, {_leaf("text")} AS node, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
  lambda a, c: list_reduce([xor(a, c)] || range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) AS crc FROM documents),
a0 AS (SELECT source AS g, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, node) - 1 AS p, count(*) OVER (PARTITION BY source) AS n, node,
  CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE node END AS changed FROM d),
{_tree("a", LEAF_LEVELS)},
b0 AS (SELECT 0 AS g, a.g AS source, row_number() OVER (ORDER BY encode(a.g) NULLS FIRST) - 1 AS p, count(*) OVER () AS n, node FROM a{LEAF_LEVELS} a),
{_tree("b", SOURCE_LEVELS)},
x AS (SELECT g, p, doc_id, node AS leaf, '' AS proof, changed AS fold FROM a0),
{_fold("a", LEAF_LEVELS, "x", "y")},
z AS (SELECT 0 AS g, b0.p, b0.node AS subroot, doc_id, leaf, proof, fold FROM y JOIN b0 ON y.g IS NOT DISTINCT FROM b0.source),
{_fold("b", SOURCE_LEVELS, "z", "w")}
SELECT doc_id, leaf, subroot, r.node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = r.node AS verified FROM w, b{SOURCE_LEVELS} r"""

OP13 = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3"""

SQL = {"op3_warc": OP3, "op5_jaccard_join": OP5, "op6_url_filters": OP6, "op7_topk": OP7, "op11_exact_dedup": OP11, "op12_merkle_manifest": OP12, "op13_hard_negatives": OP13}
