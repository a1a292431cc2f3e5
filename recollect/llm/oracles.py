"""DuckDB SQL for those corpus queries that SQL can express."""

SQL: dict[str, str] = {}


def crc_table() -> list[int]:
    """CRC-32 of each half byte, by the reflected polynomial."""
    out = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


# Bytes as pairs of hex digits, the lower half first.
_STEP = "xor({c} >> 4, list_extract(" + str(crc_table()) + "::BIGINT[], CAST((xor({c}, {v}) & 15) AS INTEGER) + 1))"
CRC = "xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, v: " + _STEP.format(c=_STEP.format(c="c", v="v"), v="(v >> 4)") + ", 4294967295::BIGINT), 4294967295::BIGINT)"

# The order is doc_id; ties among rows of one doc_id don't occur in the tables.
SQL["op1_sharding"] = f"""
WITH r AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 8 AS size, coalesce(text, '') AS text FROM documents),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total FROM r),
s AS (SELECT *, CAST(least(23, ((2 * start + size) * 24) // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CASE WHEN text = '' THEN 0 ELSE {CRC.format(text="text")} END AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""

SQL["op3_line_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
m AS (SELECT k.*, coalesce(k.doc_id > r.first, false) AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SQL["op9_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS s, w FROM w WHERE len(w) >= 35),
h AS (SELECT doc_id, s, array_to_string(list_slice(w, s, s + 34), ' ') AS g FROM g),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY g) AS n FROM h) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, s + unnest(range(0, 35)) AS p FROM r),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
k AS (SELECT x.doc_id, count(*) AS n, count(c.p) AS gone, string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE c.p IS NULL) AS kept
      FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.p GROUP BY x.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)
"""

SQL["op10_quality_rules"] = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS l FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS s, w FROM w WHERE len(w) >= 5),
h AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, w[s], w[s + 1], w[s + 2], w[s + 3], w[s + 4]) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, s + unnest(range(0, 5)) AS p FROM h WHERE n > 1) GROUP BY doc_id),
t AS (SELECT w.doc_id, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS capitals, (length(text) - length(replace(text, '!!', ''))) // 2 AS bangs,
    length(text) - length(regexp_replace(text, '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Thai}}\p{{Lao}}\p{{Khmer}}\p{{Myanmar}}\p{{Tibetan}}\x{{3000}}-\x{{303F}}\x{{FF00}}-\x{{FFEF}}]', '', 'g')) AS unspaced,
    len(string_split(text, chr(10))) AS n_lines, len(list_distinct(w)) AS n_distinct FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR n_symbols * 20 > word_chars OR (word_chars > 20 * n_words AND unspaced * 5 < word_chars) OR word_chars < 2 * n_words OR n_dup_lines * 10 > n_lines * 4
         OR capitals * 2 > word_chars OR bangs * 4 > n_words OR (n_distinct * 10 < n_words AND n_distinct * n_distinct < 50 * n_words)) AS kept
FROM b
"""

SQL["op12_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE own = label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE s.label <> p.own AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10
"""
