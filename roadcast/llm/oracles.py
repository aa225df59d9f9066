"""DuckDB SQL for the registered jobs, over the same parquet tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op1_arc_to_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT h, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY h)
SELECT p.page_id, p.payload_bytes::BIGINT AS payload_bytes, p.payload_digest,
       CASE WHEN k.top > p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.top > p.page_id THEN k.top END AS refers_to
FROM p LEFT JOIN k ON k.h = p.h
"""

ORACLES["op8_topk_tiles"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, e FROM v WHERE vec_id % 20 = 0),
s AS (
  SELECT q.query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM q JOIN v ON v.vec_id <> q.query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLES["op10_pareto_mix"] = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
o AS (
  SELECT *, 3 * source_size AS lim, row_number() OVER (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST) AS n FROM src),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
f AS (SELECT min(n) AS first_free FROM l WHERE level * weight < lim),
g AS (SELECT level AS share FROM l, f WHERE n = first_free),
t AS (
  SELECT l.*, CASE WHEN first_free IS NULL OR n < first_free THEN lim::DOUBLE ELSE share * weight END AS target
  FROM l, f LEFT JOIN g ON true),
c AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies,
         greatest(source_size // docs, 1) AS mean FROM t),
e AS (SELECT *, target - copies * source_size AS rest FROM c),
r AS (
  SELECT d.doc_id, d.size, e.*, (10000 * mean) // (mean + d.size) AS h,
         (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
w AS (SELECT *, sum(size * h) OVER (PARTITION BY source)::BIGINT AS weighed FROM r),
p AS (SELECT *, CASE WHEN weighed > 0 THEN rest * h / weighed ELSE 0.0::DOUBLE END AS pi FROM w),
x AS (
  SELECT *, CASE WHEN pi >= 1 THEN 0.0::DOUBLE ELSE u * (1 - pi) / (u * (1 - pi) + (1 - u) * pi) END AS x FROM p),
a AS (
  SELECT *, coalesce(sum(CASE WHEN size > 0 AND rest > 0 THEN size END) OVER (
    PARTITION BY source ORDER BY x, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM x)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       ((copies + CASE WHEN size > 0 AND rest > 0 AND 2 * ahead + size <= 2 * rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM a
"""


def _license_sql() -> str:
    """Every phrase and notice at every place of the word list, without an index."""
    from roadcast.llm.license_scan import BASE, NOTICES
    templates = BASE + NOTICES

    def words(text: str) -> str:
        return "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"

    def places(phrase: str) -> str:
        n = len(phrase.split())
        return f"list_filter(range(0, len(w) - {n - 1}), lambda i: w[i + 1:i + {n}] = {words(phrase)})"

    def share(k: int, notice: str, phrase: str) -> str:
        n, lead = notice.split(), phrase.split()
        lead = next(i for i in range(len(n)) if n[i:i + len(lead)] == lead)
        one = " + ".join(f"coalesce((w[a{k}[i] + {j - lead + 1}] = '{x}' AND a{k}[i] + {j - lead} >= 0)::INT, 0)" for j, x in enumerate(n))
        return f"coalesce(list_max(list_transform(range(1, len(a{k}) + 1), lambda i: ({one}) / {float(len(n))}::DOUBLE)), 0.0::DOUBLE)"

    def labels(ks) -> str:
        held = ", ".join(f"CASE WHEN len(a{k}) > 0 THEN '{templates[k].label}' END" for k in ks)
        return f"array_to_string(list_sort(list_distinct(list_filter([{held}], lambda x: x IS NOT NULL))), ',')"

    at = ", ".join(f"{places(t.phrase)} AS a{k}" for k, t in enumerate(templates))
    base = "flatten([" + ", ".join(f"a{k}" for k in range(len(BASE))) + "])"
    score = ", ".join(share(k, t.notice, t.phrase) for k, t in enumerate(templates))
    return f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, {at} FROM d),
b AS (SELECT *, {base} AS base FROM p)
SELECT doc_id, len(w)::BIGINT AS n_words, len(base)::BIGINT AS n_base, list_min(base)::BIGINT AS first_word, list_max(base)::BIGINT AS last_word,
       {labels(range(len(BASE)))} AS base_labels, {labels(range(len(templates)))} AS labels, greatest({score}) AS score
FROM b
"""


def _secret_sql() -> str:
    from roadcast.llm.secret_scan import BASE_KINDS, KINDS, LIVE_OWNERS, LIVE_REPOSITORIES, OPAQUE_NEEDS, PLACEHOLDER

    def quoted(s: str) -> str:
        return s.replace("'", "''")

    def matches(kind: str) -> str:
        pattern, group, least = KINDS[kind]
        order = list(KINDS).index(kind)
        p = quoted(pattern)
        more = "".join(f" AND regexp_matches(hit, '{x}')" for x in OPAQUE_NEEDS) if kind == "opaque" else ""
        return f"""
  SELECT id, t, owner, repo, list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda h: length(h))), 0) AS s,
         {order} AS ord, length(hit) AS n, '{kind}' AS kind, val
  FROM (SELECT id, t, owner, repo, gaps, hits, unnest(range(1, len(hits) + 1)) AS k, unnest(hits) AS hit, unnest(vals) AS val
        FROM (SELECT *, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {group}) AS vals FROM d
              WHERE regexp_matches(t, '{p}')))
  WHERE length(val) >= {least}{more}"""

    counts = ", ".join(f"coalesce(count(*) FILTER (kind = '{k}'), 0)::BIGINT AS n_{k}" for k in BASE_KINDS)
    names = ", ".join(f"'{k}'" for k in BASE_KINDS)
    text = "kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, ord"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t, coalesce(source, 'null') AS owner,
         concat_ws('/', source, lang) AS repo FROM documents),
m AS ({" UNION ALL ".join(matches(k) for k in KINDS)}),
o AS (SELECT val, count(DISTINCT owner) AS owners, count(DISTINCT owner || chr(0) || repo) AS repositories FROM m GROUP BY val),
c AS (SELECT m.*, owners <= {LIVE_OWNERS} AND repositories <= {LIVE_REPOSITORIES} AND NOT regexp_matches(m.val, '{quoted(PLACEHOLDER)}') AS live FROM m JOIN o USING (val)),
g AS (
  SELECT id, {counts}, string_agg({text}) FILTER (kind IN ({names})) AS base, string_agg({text}) FILTER (kind IN ({names}) OR live) AS spans,
         count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM c GROUP BY id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied
FROM d LEFT JOIN g USING (id)
"""

ORACLES["op11_k2_treap"] = """
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
c AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
t AS (SELECT id, doc_id, len(w) AS len, term, count(*) AS tf FROM (SELECT id, doc_id, w, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
p AS (
  SELECT t.id, t.doc_id, t.term, floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * f.df + 1)))::BIGINT
         * ((1000000000 * t.tf) // (1000 * t.tf + 20 * (100 - 50 + (50 * t.len * c.n) // c.l))) AS part
  FROM t JOIN f USING (term), c),
s AS (SELECT item_id, id, doc_id, sum(part)::BIGINT AS score FROM i JOIN p USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""

ORACLES["op12_decontamination"] = """
WITH w AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
n AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS words
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM n)),
place AS (
  SELECT id, n, s, array_to_string(w[s:s + n - 1], ' ') AS words
  FROM (SELECT id, w, l.n, unnest(range(1, len(w) - l.n + 2)) AS s FROM w, (SELECT DISTINCT n FROM win) l WHERE len(w) >= l.n)),
hit AS (SELECT p.id, p.n, p.s, win.item_id FROM place p JOIN win ON p.n = win.n AND p.words = win.words),
c AS (SELECT id, count(DISTINCT word) AS n_hit FROM (SELECT id, unnest(range(s, s + n)) AS word FROM hit) GROUP BY id),
h AS (SELECT id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT id, item_id::VARCHAR AS x FROM hit) GROUP BY id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (id) LEFT JOIN h USING (id)
"""

ORACLES["op13_prefix_trie"] = """
WITH tab AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: xor(a >> 1, 3988292384 * (a & 1))) ORDER BY n) AS t
  FROM (SELECT unnest(range(0, 256))::BIGINT AS n)),
conv AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST,
         sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
         lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) % 6 AS h
  FROM conv, tab),
reb AS (SELECT h.conv_id, list_concat(coalesce(b.turns, [])[1:h.h], h.turns[h.h + 1:]) AS p
        FROM h LEFT JOIN conv b ON b.conv_id = h.conv_id - h.conv_id % 100),
m AS (SELECT conv_id, d, p[1:d] AS path, len(p) = d AS ends FROM (SELECT *, unnest(range(0, len(p) + 1)) AS d FROM reb)),
n AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS e
  FROM m GROUP BY path, d),
k AS (SELECT *, (SELECT count(*) FROM n c WHERE c.d = n.d + 1 AND c.path[1:n.d] = n.path) AS kids,
             CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(path[d].t) END AS saved FROM n),
s AS (SELECT a.path, a.d, sum(b.saved) AS saved, count(*) FILTER (b.kids = 0) AS leaves
      FROM k a JOIN k b ON b.d >= a.d AND b.path[1:a.d] = a.path GROUP BY a.path, a.d)
SELECT k.conv_id, k.d::BIGINT AS depth, u.conv_id AS parent_conv_id, k.n_convs::BIGINT AS n_convs, k.kids::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(k.e) AS ends_sha256
FROM k JOIN s ON s.d = k.d AND s.path = k.path LEFT JOIN n u ON u.d = k.d - 1 AND u.path = k.path[1:k.d - 1]
"""


ORACLES["op5_license_index"] = _license_sql()
ORACLES["op7_secret_owners"] = _secret_sql()
