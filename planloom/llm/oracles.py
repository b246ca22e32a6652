"""The same results in SQL, for the queries that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keep_id FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, pos, line, keep_id IS NOT NULL AND keep_id <> doc_id AS gone
  FROM keyed LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)
), hits AS (SELECT doc_id, i, size, item_id FROM places JOIN windows USING (size, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""

# Texts as two hexadecimal digits a byte; a window is 100 bytes.
_REPEATS = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 200)) AS w
  FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 - 99 AS BIGINT))) AS s FROM docs)
), ranked AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS n FROM windows
), later AS (SELECT doc_id, s FROM ranked WHERE n > 1),
edges AS (
  SELECT doc_id, s, s + 100 AS e,
    coalesce(s > max(s + 100) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh
  FROM later
), numbered AS (
  SELECT doc_id, s, e, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM edges
), spans AS (SELECT doc_id, span, min(s) AS s, max(e) AS e FROM numbered GROUP BY doc_id, span),
pieces AS (
  SELECT doc_id, span, s, e, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM spans
), kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(e - s) AS n_removed, max(e) AS tail,
    string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY span) AS front
  FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(n_spans, 0) AS n_spans,
  sha256(from_hex(coalesce(front, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""



def _vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """One step per round: components and entries as rows, sums of squares, the least by distance and index."""
    steps = [
        f"""
WITH kept AS (
  SELECT vec_id, label, embedding AS e, len(embedding) // {parts} AS width FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS (
  SELECT vec_id, (i - 1) // width AS part, (i - 1) % width AS place, CAST(floor(CAST(e[i] AS DOUBLE) * {scale}) AS BIGINT) AS v
  FROM (SELECT vec_id, e, width, unnest(range(1, len(e) + 1)) AS i FROM kept)
), first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}),
book0 AS (SELECT part, entry, place, v FROM cells JOIN first USING (vec_id))"""
    ]
    for n in range(rounds + 1):
        steps.append(f"""
apart{n} AS (
  SELECT vec_id, part, entry, sum((c.v - b.v) * (c.v - b.v)) AS d FROM cells c JOIN book{n} b USING (part, place)
  GROUP BY vec_id, part, entry
), near{n} AS (
  SELECT vec_id, part, min((d, entry)) AS best FROM apart{n} GROUP BY vec_id, part
)""")
        if n < rounds:
            steps.append(f"""
moved{n} AS (
  SELECT part, best[2] AS entry, place, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v
  FROM near{n} JOIN cells USING (vec_id, part) GROUP BY ALL
), book{n + 1} AS (
  SELECT part, entry, place, coalesce(m.v, b.v) AS v FROM book{n} b LEFT JOIN moved{n} m USING (part, entry, place)
)""")
    steps.append(f"""
coded AS (
  SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error
  FROM near{rounds} GROUP BY vec_id
), digest AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM book{rounds})""")
    return ",".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest
"""


ORACLES = {
    "op4_line_dedup": _LINE_DEDUP,
    "op6_repeated_passages": _REPEATS,
    "op9_benchmark_decontamination": _DECONTAMINATION,
    "op10_exact_dedup": _EXACT_DEDUP,
    "op12_vector_codes": _vector_codes(),
}
