"""SQL counterparts of the registered queries, for DuckDB."""

from __future__ import annotations

from charscape.llm.quality import COMMON, Rules, vocabulary

WORD = r"[^\x20\x09-\x0D]+"

OP7 = rf"""
WITH sized AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    md5('mix:' || doc_id::VARCHAR) AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources
), walked AS (
  SELECT *, 3 * source_size AS cap,
    sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS left_words,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS left_weight
  FROM weighed
  WINDOW before AS (ORDER BY source_size::DOUBLE / weight, place
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), edge AS (
  SELECT arg_max(left_words, left_weight) AS open_words, max(left_weight) AS open_weight
  FROM walked WHERE cap * left_weight >= left_words * weight
), targets AS (
  SELECT source, source_size,
    CASE WHEN left_weight <= open_weight
      THEN (open_words * weight)::DOUBLE / open_weight::DOUBLE ELSE cap::DOUBLE END AS target
  FROM walked, edge
), placed AS (
  SELECT doc_id, size, source_size, target, round(target)::BIGINT AS goal,
    sum(size) OVER (PARTITION BY s.source ORDER BY key, size
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN size = 0 THEN 0 ELSE size * (goal // source_size)
    + least(size, greatest(0, goal % source_size - before)) END)::BIGINT AS taken
FROM placed
"""


OP1 = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100
    THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first
  FROM hashed
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END
    AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM firsts
"""



def op2(words: int = 2, percent: int = 80, source: str = "documents", name: str = "component") -> str:
    """CTEs up to one named `name`: n (row number), doc_id, n_shingles, component_id."""
    p = name[0]
    return rf"""
{p}_rows AS (
  SELECT row_number() OVER () AS n, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM {source}
), {p}_shingles AS (
  SELECT DISTINCT n, CASE WHEN len(w) < {words} THEN array_to_string(w, ' ')
    ELSE array_to_string(w[i:i + {words} - 1], ' ') END AS s
  FROM (SELECT n, w, unnest(range(1, greatest(1, len(w) - {words} + 1) + 1)) AS i
        FROM {p}_rows WHERE len(w) > 0)
), {p}_sizes AS (
  SELECT n, count(*) AS k FROM {p}_shingles GROUP BY n
), {p}_links AS (
  SELECT a.n AS x, b.n AS y
  FROM {p}_shingles a JOIN {p}_shingles b ON a.s = b.s AND a.n <> b.n
  GROUP BY a.n, b.n
  HAVING 100 * count(*) >= {percent} * (
    (SELECT k FROM {p}_sizes z WHERE z.n = a.n) + (SELECT k FROM {p}_sizes z WHERE z.n = b.n)
    - count(*))
), {p}_reach AS (
  SELECT n AS x, n AS y FROM {p}_rows
  UNION
  SELECT r.x, l.y FROM {p}_reach r JOIN {p}_links l ON r.y = l.x
), {name} AS (
  SELECT r.x AS n, any_value(d.doc_id) AS doc_id, coalesce(any_value(z.k), 0)::BIGINT AS n_shingles,
    min(e.doc_id) AS component_id
  FROM {p}_reach r JOIN {p}_rows d ON d.n = r.x JOIN {p}_rows e ON e.n = r.y
  LEFT JOIN {p}_sizes z ON z.n = r.x
  GROUP BY r.x
)"""


OP2 = f"""WITH RECURSIVE {op2()}
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM component
"""


def _listed(items: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in items)


def op3(rules: Rules = Rules(), source: str = "documents") -> str:
    """CTEs up to `verdict`: one row per document row."""
    words = vocabulary()
    covered = "length(body) - length(regexp_replace(body, '{}', '', 'g'))".format
    return rf"""
base AS (
  SELECT row_number() OVER () AS n, doc_id, lang, coalesce(text, '') AS body,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS tokens
  FROM {source}
), windows AS (
  SELECT n, unnest(range(1, len(tokens) - 1)) AS i, unnest(list_transform(
    list_zip(tokens[:-3], tokens[2:-2], tokens[3:]),
    lambda t: t[1] || ' ' || t[2] || ' ' || t[3])) AS g
  FROM base WHERE len(tokens) >= 3
), repeats AS (
  SELECT n, i, count(*) OVER (PARTITION BY n, g) AS k FROM windows
), repeated AS (
  SELECT n, count(DISTINCT i + d)::BIGINT AS n_repeat_words
  FROM repeats, (VALUES (0), (1), (2)) t(d) WHERE k >= 2 GROUP BY n
), counted AS (
  SELECT b.n, doc_id, lang, body, len(tokens)::BIGINT AS n_words,
    length(array_to_string(tokens, ''))::BIGINT AS word_chars,
    ({covered('[#*$%&|<>]+')})::BIGINT AS n_symbols,
    (SELECT len(l) - len(list_distinct(l)) FROM (SELECT list_filter(string_split(body, chr(10)),
      lambda x: regexp_matches(x, '[^ 	-
]')) AS l))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    {covered('[A-Z]+')} AS upper, {covered('[0-9]+')} AS digit,
    {covered('[.,;:!?]+')} AS stop, strlen(body) - length(body) AS wide,
    length(body) AS chars,
    list_filter(regexp_extract_all(regexp_replace(lower(body), '[.,;:]+', '', 'g'), '{WORD}'),
      lambda x: x IN ({_listed(words)})) AS common
  FROM base b LEFT JOIN repeated r USING (n)
), cells AS (
  SELECT n, lang, 'class' AS kind, unnest(['u', 'd', 's', 'w', 'y', 'r', 'b']) AS cell,
    unnest([upper, digit, stop, wide, n_symbols,
      greatest(0, word_chars - (upper + digit + stop + wide + n_symbols)),
      chars - word_chars])::DOUBLE AS v
  FROM counted
  UNION ALL
  SELECT n, any_value(lang), 'word', w, count(*)::DOUBLE
  FROM (SELECT n, lang, unnest(common) AS w FROM counted) GROUP BY n, w
  UNION ALL
  SELECT n, lang, 'word', '', greatest(0, n_words - len(common))::DOUBLE FROM counted
), shares AS (
  SELECT n, kind, cell, v / sum(v) OVER (PARTITION BY n, kind) AS p FROM cells
), refs AS (
  SELECT lang, kind, cell, v / sum(v) OVER (PARTITION BY lang, kind) AS q
  FROM (SELECT lang, kind, cell, sum(v) AS v FROM cells
        WHERE lang IN ({_listed(sorted(COMMON))}) GROUP BY lang, kind, cell)
), kinds AS (
  SELECT n, kind, lang FROM (SELECT n, kind FROM cells GROUP BY n, kind HAVING sum(v) > 0)
  JOIN (SELECT DISTINCT lang, kind FROM refs) USING (kind)
), paired AS (
  SELECT k.n, k.kind, k.lang, r.cell, coalesce(s.p, 0) AS p, r.q AS q
  FROM kinds k JOIN refs r USING (lang, kind)
  LEFT JOIN shares s ON s.n = k.n AND s.kind = k.kind AND s.cell = r.cell
  UNION ALL
  SELECT k.n, k.kind, k.lang, s.cell, s.p, 0
  FROM kinds k JOIN shares s ON s.n = k.n AND s.kind = k.kind
  ANTI JOIN refs r ON r.lang = k.lang AND r.kind = k.kind AND r.cell = s.cell
), distances AS (
  SELECT n, kind, min(d) AS d FROM (
    SELECT n, kind, lang, sqrt(greatest(0, sum(
      CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
      + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS d
    FROM paired GROUP BY n, kind, lang) GROUP BY n, kind
), verdict AS (
  SELECT c.*, n_words < {rules.min_words}
      OR 100 * n_repeat_words > {rules.repeat_percent} * n_words AS base_failed,
    (lang IS NULL OR lang IN ({_listed(sorted(COMMON))})) AS judged,
    coalesce(x.d > {rules.max_class_distance}, false)
      AND upper + digit + stop + wide + n_symbols + chars - word_chars
        + greatest(0, word_chars - (upper + digit + stop + wide + n_symbols))
        >= {rules.min_class_count} AS class_far,
    coalesce(y.d > {rules.max_word_distance}, false) AND n_words >= {rules.min_word_count} AS word_far
  FROM counted c LEFT JOIN distances x ON x.n = c.n AND x.kind = 'class'
  LEFT JOIN distances y ON y.n = c.n AND y.kind = 'word'
)"""


OP3 = f"""WITH {op3()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (judged AND (class_far OR word_far)) AS kept
FROM verdict
"""

OP4 = """
WITH codes AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM codes q JOIN codes v ON q.vec_id <> v.vec_id AND len(q.c) = len(v.c)
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def _clustering(clusters: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    """Rounds written out, each as an assignment and the centroids after it."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
distances{n} AS (
  SELECT row_no, cluster, list_sum(list_transform(list_zip(v.codes, c.codes),
    lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance
  FROM kept v, centroids{n} c
), assigned{n} AS MATERIALIZED (
  SELECT row_no, min_by(cluster, (distance, cluster)) AS cluster, min(distance) AS distance
  FROM distances{n} GROUP BY row_no
), sums{n} AS (
  SELECT cluster, place, sum(code)::BIGINT AS total, count(*) AS n
  FROM (SELECT cluster, unnest(codes) AS code, unnest(range({dims})) AS place
        FROM kept JOIN assigned{n} USING (row_no))
  GROUP BY cluster, place
), centroids{n + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(moved, codes) AS codes FROM centroids{n} LEFT JOIN (
    SELECT cluster, list((total - ((total % n) + n) % n) // n ORDER BY place) AS moved
    FROM sums{n} GROUP BY cluster) USING (cluster)
)""")
    return f"""
WITH rows AS (
  SELECT row_number() OVER () AS row_no, vec_id, embedding FROM embeddings
), kept AS MATERIALIZED (
  SELECT row_no, vec_id,
    list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS codes
  FROM rows
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dims}
), centroids0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), codes) - 1)::INTEGER AS cluster, codes
  FROM kept WHERE vec_id IS NOT NULL
  QUALIFY cluster < {clusters}
), {",".join(steps)}
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.codes, ',')) AS centroid_sha256
FROM kept JOIN assigned{rounds} USING (row_no) JOIN centroids{rounds} c USING (cluster)
"""


OP11 = _clustering()

# Every denominator of the limit for parted texts is tried at once, as `share`; the first that keeps shards
# equal is taken. CRC32 has no function: it is folded over the bytes with a table made in `remainders`.
OP12 = """
WITH RECURSIVE remainders AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda v, s: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v
    FROM (SELECT unnest(range(256))::BIGINT AS i))
), sized AS MATERIALIZED (
  SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size,
    CASE WHEN text IS NULL THEN '00' ELSE '01' END || md5(coalesce(text, '')) AS text_key,
    coalesce(md5(doc_id::VARCHAR), '') AS id_key,
    xor(list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM documents, remainders
), whole AS (
  SELECT sum(size)::BIGINT AS total, sum(size)::BIGINT // 1024 AS least FROM sized
), listed AS (
  SELECT text_key, sum(size)::BIGINT AS b, count(*) AS n FROM sized, whole
  GROUP BY text_key, least HAVING b > least OR n > 1000000
), units AS (
  SELECT share, text_key, CASE WHEN together THEN b ELSE b // n END AS size,
    unnest(range(CASE WHEN together THEN 1 WHEN b // n > least THEN n ELSE 0 END)) AS copy, together
  FROM (SELECT *, b * 16 * share <= total OR share = 64 AND b <= least AS together
        FROM listed, whole, (SELECT unnest([2, 4, 8, 16, 32, 64]) AS share))
), ordered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY share ORDER BY size DESC, text_key, copy) AS i FROM units
), deal AS (
  SELECT unnest([2, 4, 8, 16, 32, 64]) AS share, 0::BIGINT AS i, list_transform(range(16), lambda x: 0::BIGINT) AS loads,
    NULL::VARCHAR AS text_key, NULL::BIGINT AS copy, NULL::BOOLEAN AS together, NULL::BIGINT AS shard
  UNION ALL
  SELECT d.share, o.i, list_transform(d.loads, lambda load, place:
      CASE WHEN place = list_position(d.loads, list_min(d.loads)) THEN load + o.size ELSE load END),
    o.text_key, o.copy, o.together, list_position(d.loads, list_min(d.loads)) - 1
  FROM deal d JOIN ordered o ON o.share = d.share AND o.i = d.i + 1
), ends AS (
  SELECT share, arg_max(loads, i) AS loads FROM deal GROUP BY share
), chosen AS MATERIALIZED (
  SELECT share, loads FROM ends, whole
  WHERE share = 64 OR list_max(loads) * 1024 <= total * 65
  ORDER BY share LIMIT 1
), places AS (
  SELECT text_key, copy, together, shard FROM deal JOIN chosen USING (share) WHERE deal.i > 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY text_key ORDER BY id_key) - 1 AS copy FROM sized
), keyed AS MATERIALIZED (
  SELECT s.*, CASE WHEN l.text_key IS NOT NULL THEN s.text_key || s.id_key || lpad(copy::VARCHAR, 12, '0')
    ELSE s.text_key END AS place
  FROM numbered s LEFT JOIN listed l ON l.text_key = s.text_key
), fixed AS (
  SELECT k.*, p.shard AS fixed FROM keyed k
  LEFT JOIN places p ON p.text_key = k.text_key AND (p.together OR p.copy = k.copy)
), loads AS (
  SELECT unnest(loads) AS load, unnest(range(16)) AS shard FROM chosen
), rest AS (
  SELECT total - (SELECT sum(load) FROM loads)::BIGINT AS rest FROM whole
), levels AS (
  SELECT k, rest + sum(load) OVER (ORDER BY k)::BIGINT AS level, load
  FROM (SELECT load, row_number() OVER (ORDER BY load) AS k FROM loads), rest
), level AS (
  SELECT max(k) AS k, max_by(level, k) AS level FROM levels WHERE level > load * k OR k = 1
), edges AS (
  SELECT shard, 2 * sum(greatest(0, level - k * load)) OVER (ORDER BY shard)::BIGINT AS edge, k FROM loads, level
), middles AS (
  SELECT *, (2 * sum(fill) OVER (ORDER BY place) - sum(fill) OVER (PARTITION BY place))::BIGINT AS middle
  FROM (SELECT *, CASE WHEN fixed IS NULL THEN size ELSE 0 END AS fill FROM fixed)
), sharded AS (
  SELECT *, coalesce(fixed, (SELECT count(*) FROM edges e WHERE e.shard < 15 AND m.middle * e.k >= e.edge)) AS shard
  FROM middles m
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY place, id_key, copy) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM sharded
"""


ORACLES: dict[str, str] = {
    "op1_warc": OP1,
    "op2_minhash": OP2,
    "op3_quality_rules": OP3,
    "op4_exact_top_k": OP4,
    "op7_mixing": OP7,
    "op11_clustering": OP11,
    "op12_sharding": OP12,
}
