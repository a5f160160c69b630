"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_BLANK = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"

SQL: dict[str, str] = {
    "op1_one_bit_search": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT q.vec_id AS query_id, c.vec_id,
  list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 5""",
    "op2_line_frequency": rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM documents),
w AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
r AS (SELECT doc_id, i, CASE WHEN lead(w, 4) OVER o IS NOT NULL THEN concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) END AS run FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM r WHERE run IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1),
spans AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) s(k) GROUP BY doc_id),
base AS (SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN spans USING (doc_id)),
l AS (SELECT doc_id, host, t, unnest(lines) AS x FROM d),
n AS (SELECT doc_id, host, t, lower(trim(regexp_replace(x, '{_BLANK}+', ' ', 'g'))) AS line, len(regexp_extract_all(x, '{_WORD}')) AS k FROM l),
hosts AS (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host),
often AS (SELECT host, line FROM n JOIN hosts USING (host) GROUP BY host, line, docs HAVING count(DISTINCT t) > 20 AND count(DISTINCT t) > 0.1 * docs),
gone AS (SELECT doc_id, count(*) AS lines, sum(k)::BIGINT AS words FROM n JOIN often USING (host, line) GROUP BY doc_id),
joined AS (SELECT base.*, coalesce(gone.lines, 0)::BIGINT AS n_removed_lines, coalesce(gone.words, 0)::BIGINT AS n_removed_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base LEFT JOIN gone USING (doc_id))
SELECT *, NOT base_failed AND NOT (n_words - n_removed_words < 10 OR n_words - n_removed_words < 0.3 * n_words) AS kept FROM joined""",
}
