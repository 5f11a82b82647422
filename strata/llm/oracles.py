"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

OP1 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
s AS (SELECT doc_id, unnest(s) AS x FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 85 * (len(x.s) + len(y.s) - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.root)
SELECT n.doc_id, CAST(len(n.s) AS BIGINT) AS n_shingles, c.component_id, c.component_id = n.doc_id AS kept
FROM n JOIN (SELECT doc_id, MIN(root) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = n.doc_id"""

OP3 = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, MIN(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.h AS payload_digest, CASE WHEN f.first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN f.first < page_id THEN f.first END AS refers_to FROM p LEFT JOIN f ON f.h = p.h AND p.n >= 100"""

OP4 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, u.vec_id, CAST(SUM(q.x * u.x) AS BIGINT) AS score FROM u q JOIN u ON u.i = q.i AND u.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10"""

_WORDS = f"regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP5 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item, least(len(w), 10) AS m, unnest(list_transform(range(1, CAST(greatest(len(w), 10) AS BIGINT) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) AS x FROM b WHERE len(w) > 0),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, unnest(range(1, CAST(len(w) AS BIGINT) - m + 2)) AS i, w FROM d CROSS JOIN ms WHERE len(w) >= m),
h AS (SELECT doc_id, i, bw.m, item FROM (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS x FROM dw) z JOIN bw ON bw.m = z.m AND bw.x = z.x),
c AS (SELECT doc_id, COUNT(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, COUNT(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS s FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

_TURN = "CONCAT('<|im_start|>', {0}role, chr(10), {0}text, '<|im_end|>', chr(10))"
_SIZE = "(len('<|im_start|>') + length(role) + 1 + length(text) + len('<|im_end|>') + 1)"
OP10 = f"""WITH t AS (SELECT conv_id, (conv_id - (conv_id % 2 + 2) % 2) // 2 AS pair_id, (conv_id % 2 + 2) % 2 AS side, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT pair_id, COUNT(*) FILTER (side = 0) AS nc, COUNT(*) FILTER (side = 1) AS nr FROM t GROUP BY pair_id HAVING nc > 0 AND nr > 0),
f AS (SELECT a.pair_id, MIN(a.i) AS k FROM t a JOIN t b ON b.pair_id = a.pair_id AND b.i = a.i AND a.side = 0 AND b.side = 1 WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id),
p AS (SELECT n.pair_id, coalesce(f.k - 1, least(nc, nr)) AS k FROM n LEFT JOIN f USING (pair_id)),
x AS (SELECT t.*, p.k, SUM({_SIZE}) OVER (PARTITION BY conv_id, i > p.k ORDER BY i) AS z FROM t JOIN p USING (pair_id))
SELECT pair_id, pair_id * 2 AS chosen_id, pair_id * 2 + 1 AS rejected_id, ANY_VALUE(k) AS n_prompt_turns,
coalesce(string_agg({_TURN.format('')}, '' ORDER BY i) FILTER (side = 0 AND i <= k), '') AS prompt,
coalesce(string_agg({_TURN.format('')}, '' ORDER BY i) FILTER (side = 0 AND i > k), '') AS chosen,
coalesce(string_agg({_TURN.format('')}, '' ORDER BY i) FILTER (side = 1 AND i > k), '') AS rejected,
coalesce(string_agg(CONCAT(CAST(z - length(text) - 11 AS BIGINT), '-', CAST(z AS BIGINT)), ',' ORDER BY i) FILTER (side = 0 AND i > k AND role = 'assistant'), '') AS chosen_mask,
coalesce(string_agg(CONCAT(CAST(z - length(text) - 11 AS BIGINT), '-', CAST(z AS BIGINT)), ',' ORDER BY i) FILTER (side = 1 AND i > k AND role = 'assistant'), '') AS rejected_mask
FROM x GROUP BY pair_id"""



def _crc_table() -> str:
    """The 256 remainders of crc32, by its rule, as a list literal."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        out.append(str(c))
    return f"CAST([{', '.join(out)}] AS BIGINT[])"


OP11 = f"""WITH RECURSIVE o AS (SELECT CAST(doc_id AS VARCHAR) AS id, unnest(regexp_extract_all({_FOLDED}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
g AS (SELECT id, run, COUNT(*) AS n FROM o WHERE length(run) >= 5 GROUP BY ALL),
b AS (SELECT id, run, n, flatten(list_transform(string_split(coalesce(id, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END)) AS x,
  t.t FROM g CROSS JOIN (SELECT {_crc_table()} AS t) t),
h AS (SELECT run, n, xor(list_reduce(x, lambda c, d: xor(c >> 8, t[(xor(c, d) & 255) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS h FROM b),
d AS (SELECT CASE WHEN h % 97 = 0 THEN run[1:CAST(h % length(run) AS INT)] || run[CAST(h % length(run) AS INT) + 2:] ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(SUM(n) AS BIGINT) AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING SUM(n) >= 3),
k AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
c AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS less FROM k),
p AS (SELECT x.word AS a, y.word AS b FROM c x JOIN c y ON x.i = y.i AND x.less = y.less AND x.word <> y.word AND length(x.word) = length(y.word)
  UNION SELECT c.word, v.word FROM c JOIN v ON v.word = c.less UNION SELECT v.word, c.word FROM c JOIN v ON v.word = c.less),
s AS (SELECT a, b, v.n, row_number() OVER (PARTITION BY a ORDER BY v.n DESC, encode(b)) AS r, COUNT(*) OVER (PARTITION BY a) AS n_near FROM p JOIN v ON v.word = p.b),
f AS (SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN s.n >= 2 * v.n THEN b END AS form, CASE WHEN s.n >= 2 * v.n THEN s.n END AS form_n FROM v LEFT JOIN s ON s.a = v.word AND r = 1),
w AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT w.word, f.word, f.form FROM w JOIN f ON f.word = w.next)
SELECT f.word, f.form, w.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM f JOIN w ON w.word = f.word AND w.next IS NULL"""

OP12 = f"""WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
r AS (SELECT key, MAX(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING COUNT(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM k LEFT JOIN r ON r.key = k.key)
SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""


def _grams(k: int) -> str:
    return f"SELECT lang, x[i:i + {k - 1}] AS p FROM (SELECT lang, x, unnest(range(1, CAST(len(x) AS BIGINT) - {k - 2})) AS i FROM w WHERE len(x) >= {k})"


OP13 = f"""WITH q AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_FOLDED}, '[.,;:!?\x0A-\x0D]')) AS x FROM documents),
w AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS x FROM q),
n AS (SELECT lang, CAST(SUM(len(x)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, p, COUNT(*) AS f FROM ({' UNION ALL '.join(map(_grams, range(1, 5)))}) GROUP BY lang, p HAVING COUNT(*) >= 30),
c AS (SELECT lang, p, f AS a FROM f WHERE len(p) >= 2),
k AS (SELECT lang, p, a, unnest(range(1, CAST(len(p) AS BIGINT))) AS k FROM c),
s AS (SELECT k.lang, k.p, a, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f::HUGEINT + y.f) AS score, k FROM k JOIN f x ON x.lang = k.lang AND x.p = k.p[1:k.k] JOIN f y ON y.lang = k.lang AND y.p = k.p[k.k + 1:]),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS z FROM s),
u AS (SELECT lang, a, len(p) AS m, unnest(flatten(list_transform(range(1, CAST(len(p) AS BIGINT)), lambda i: list_transform(range(i + 1, CAST(len(p) AS BIGINT) + 1), lambda j: p[i:j])))) AS p FROM c WHERE len(p) > 2),
g AS (SELECT lang, p, MAX(a) AS longer FROM u WHERE len(p) < m GROUP BY lang, p),
o AS (SELECT b.lang, array_to_string(b.p, ' ') AS phrase, b.a, l, r, CAST(score AS BIGINT) AS score FROM b LEFT JOIN g ON g.lang = b.lang AND g.p = b.p WHERE z = 1 AND (longer IS NULL OR 100 * longer < 80 * b.a)),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n.n, score FROM t JOIN n USING (lang) WHERE rank <= 2000"""

ORACLE_SQL = {
    "op1_minhash_near_dedup": OP1,
    "op3_warc": OP3,
    "op4_bit_sliced_top_k": OP4,
    "op5_decontaminate": OP5,
    "op10_preference_format": OP10,
    "op11_spelling_variants": OP11,
    "op12_line_dedup": OP12,
    "op13_collocations": OP13,
}
