"""DuckDB SQL for the contracts of the dedup operators, over the table ``documents``.

Each states its contract the plain way, by windows over words or bytes. The self-join and the
recursion of OP5_SQL are for tables of a few thousand rows.
"""

from __future__ import annotations


def _leads(column: str, count: int) -> str:
    return ", ".join(f"lead({column}, {k}) OVER d" for k in range(1, count))


def _doubled(lengths: tuple[int, ...]) -> str:
    """k2, k4, ...: a hash of the bytes from each place on, made of the two halves' hashes."""
    made, before, key = [], "bytes", "b"
    for n in lengths:
        made.append(
            f"k{2 * n} AS (SELECT doc_id, p, b, md5({key} || '.' || lead({key}, {n}) OVER d) AS k "
            f"FROM {before} WINDOW d AS (PARTITION BY doc_id ORDER BY p))"
        )
        before, key = f"k{2 * n}", "k"
    return ",\n".join(made)


OP3_SQL = r"""
WITH norm AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM norm
"""

#: 100 bytes are two overlapping runs of 64.
OP4_SQL = rf"""
WITH bytes AS (
  SELECT doc_id, generate_subscripts(b, 1) AS p, unnest(b) AS b
  FROM (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents)
),
{_doubled((1, 2, 4, 8, 16, 32))},
starts AS (SELECT doc_id, p, b, md5(k || '.' || lead(k, 36) OVER d) AS k FROM k64 WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
seen AS (SELECT doc_id, p, b, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1 AS hit FROM starts),
marked AS (
  SELECT doc_id, p, b, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM seen
),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM marked),
done AS (
  SELECT doc_id, count(*) AS n_bytes, count_if(gone)::BIGINT AS n_removed, count_if(opens)::BIGINT AS n_spans,
         string_agg(b, '' ORDER BY p) FILTER (NOT gone) AS kept
  FROM runs GROUP BY doc_id
)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM documents LEFT JOIN done USING (doc_id)
"""

def _similar(words: int, columns: str = "") -> str:
    """Components of documents by the similarity of their shingles of so many words."""
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS word, len(w) AS n
  FROM (SELECT doc_id, regexp_extract_all(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents)
),
grams AS (
  SELECT DISTINCT doc_id, k FROM (
    SELECT doc_id, p, n, concat_ws(' ', word, {_leads("word", words)}) AS k FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY p)
  ) WHERE p = 1 OR p <= n - {words - 1}
),
sizes AS (SELECT doc_id, count(*) AS size FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n >= 80 * (x.size + y.size - n)
),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(size), 0) AS n_shingles, least(d.doc_id, min(r.b)) AS component_id{columns}
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""


OP5_SQL = _similar(5)
OP12_SQL = _similar(4, ", d.doc_id = least(d.doc_id, min(r.b)) AS kept")

OP9_SQL = rf"""
WITH words AS (
  SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS word
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
),
starts AS (
  SELECT doc_id, p, word, CASE WHEN lead(p, 12) OVER d IS NOT NULL THEN concat_ws(' ', word, {_leads("word", 13)}) END AS k
  FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY p)
),
seen AS (SELECT doc_id, p, word, k IS NOT NULL AND min(doc_id) OVER (PARTITION BY k) < doc_id AS hit FROM starts),
marked AS (
  SELECT doc_id, p, word, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM seen
),
done AS (
  SELECT doc_id, count(*) AS n_words, count_if(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN done USING (doc_id)
"""

#: Phrases are lists of words here.
OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece
  FROM documents
),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (
  SELECT lang, k, w[i:i + k - 1] AS p, count(*) AS f FROM starts, range(1, 6) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100
),
cuts AS (
  SELECT g.lang, g.k, g.p, g.f AS a, j, x.f AS l, y.f AS r, n, ((1000::HUGEINT * g.f * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM grams g JOIN totals USING (lang), range(1, 5) t(j), grams x, grams y
  WHERE j < g.k AND x.lang = g.lang AND x.p = g.p[1:j] AND y.lang = g.lang AND y.p = g.p[j + 1:g.k]
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
inner_parts AS (
  SELECT DISTINCT lang, f, p[i:i + m - 1] AS p FROM grams, range(1, 5) s(i), range(2, 5) t(m) WHERE m < k AND i + m - 1 <= k
),
whole AS (
  SELECT * FROM lowest c WHERE NOT EXISTS (FROM inner_parts i WHERE i.lang = c.lang AND i.p = c.p AND i.f >= c.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank,
       array_to_string(p, ' ') AS phrase, a, l, r, n, score
FROM whole QUALIFY rank <= 2000
"""

#: Doubles hold these sums exactly.
OP13_SQL = """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM fine a JOIN fine b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 3
"""
