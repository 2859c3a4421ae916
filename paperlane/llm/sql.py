"""DuckDB SQL for the rows of those corpus queries that SQL can express over whole tables."""

from __future__ import annotations

from paperlane.llm.line_dedup import MIN_PAGES, RATIO
from paperlane.llm.sharding import MULTIPLIER


def _nibble(n: int) -> int:
    """The crc32 of four bits: the reflected polynomial four times."""
    for _ in range(4):
        n = n >> 1 ^ 0xEDB88320 * (n & 1)
    return n


def crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a text's UTF-8 bytes, four bits at a time."""
    table = f"[{', '.join(str(_nibble(n)) for n in range(16))}]"
    step = lambda c: f"xor({c} >> 4, {table}[({c} & 15) + 1])"
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce({octets}, lambda c, b: {step(step('xor(c, b)'))}, 4294967295::BIGINT))"


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

LINE_DEDUP = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, text IS NULL AS missing FROM documents),
lines AS (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE NOT missing),
norm AS (SELECT *, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS n FROM lines),
totals AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
bad AS (
  SELECT p.source, p.n FROM (SELECT source, n, count(DISTINCT r) AS k FROM norm WHERE n <> '' GROUP BY source, n) p
  JOIN totals t ON p.source IS NOT DISTINCT FROM t.source WHERE k >= {MIN_PAGES} AND k > t.pages * {RATIO}
),
kept AS (
  SELECT x.r, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE b.n IS NULL) AS kept
  FROM norm x LEFT JOIN bad b ON x.n = b.n AND x.source IS NOT DISTINCT FROM b.source GROUP BY x.r
)
SELECT d.doc_id, length(string_split(d.text, chr(10)))::BIGINT AS n_lines, (length(d.text) - length(coalesce(kept, '')))::BIGINT AS n_cut, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

DECONTAMINATE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[pos : pos + least(10, len(w)) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS pos FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, pos, array_to_string(w[pos : pos + k - 1], ' ') AS win FROM (SELECT r, k, w, unnest(generate_series(1, len(w) - k + 1)) AS pos FROM d, widths WHERE len(w) >= k)),
hit AS (SELECT dw.r, dw.pos, dw.k, bw.item_id FROM dw JOIN bw USING (k, win)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(pos, pos + k - 1)) AS p FROM (SELECT DISTINCT r, pos, k FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit) GROUP BY r)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s) WHERE rank <= 20
"""

RESAMPLING = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM benchmark),
df AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
place AS (SELECT f, {crc32("f")} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf)),
ours AS (SELECT bucket, count(*) AS s FROM df JOIN place USING (f) GROUP BY bucket),
theirs AS (SELECT bucket, count(*) AS t FROM bf JOIN place USING (f) GROUP BY bucket),
gains AS (
  SELECT range AS bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bf) + 10000))))::BIGINT AS gain
  FROM range(10000) LEFT JOIN ours ON bucket = range LEFT JOIN theirs ON theirs.bucket = range
),
sums AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM df JOIN place USING (f) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5) / 4294967296))))::BIGINT AS score
  FROM d LEFT JOIN sums USING (r)
),
ranked AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM d WHERE len(w) >= 20) * 25 // 100 THEN place END::BIGINT AS rank FROM ranked
"""

PREFIX_TRIE = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
built AS (
  SELECT c.conv_id, 0 AS own, t.p, role, text FROM c JOIN t ON t.conv_id = c.base AND t.p <= h
  UNION ALL SELECT c.conv_id, 1, t.p, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.p > h
),
lists AS (SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY own, p) AS ts, list(length(text) ORDER BY own, p) AS ns FROM built GROUP BY conv_id),
prefixes AS (
  SELECT conv_id, d, len(ts) AS l, sha256(array_to_string(ts[:d], ',')) AS k, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS n
  FROM (SELECT conv_id, coalesce(ts, []) AS ts, ns, unnest(range(0, len(coalesce(ts, [])) + 1)) AS d FROM c LEFT JOIN lists USING (conv_id))
),
nodes AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = l) AS ends FROM prefixes GROUP BY k, d),
up AS (SELECT x.k, p.k AS parent, o.conv_id AS parent_conv_id FROM nodes x JOIN prefixes p ON p.conv_id = x.conv_id AND p.d = x.d - 1 JOIN nodes o ON o.k = p.k),
kids AS (SELECT parent AS k, count(*) AS n_children FROM up GROUP BY parent),
below AS (
  SELECT p.k, sum((x.n_convs - 1) * x.n) AS saved, count(*) FILTER (WHERE kids.k IS NULL) AS leaves
  FROM nodes x LEFT JOIN kids ON kids.k = x.k JOIN prefixes p ON p.conv_id = x.conv_id AND p.d <= x.d GROUP BY p.k
)
SELECT x.conv_id, x.d::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM nodes x JOIN below USING (k) LEFT JOIN up USING (k) LEFT JOIN kids USING (k)
"""

ORACLES = {"op5_topk": TOP_K, "op7_line_dedup": LINE_DEDUP, "op9_decontaminate": DECONTAMINATE, "op12_resampling": RESAMPLING, "op13_prefix_trie": PREFIX_TRIE}
