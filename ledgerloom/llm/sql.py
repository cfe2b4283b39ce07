"""SQL that states the results of the text queries, where SQL can."""

P2_FOUND = """
SELECT DISTINCT c.chunk_key FROM chunks c JOIN chunk_limits l ON l.chunk_config = coalesce(c.chunk_config, 'table_aware_mixed')
WHERE len(regexp_extract_all(c.text, '[^ \\t\\n]+')) > l.max_words"""

_CANON = r"""translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
 lower(coalesce({0}, '')), '[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{3000}}]+', chr(4), 'g'), '(\d)[.](\d)', '\1' || chr(5) || '\2', 'g'), '(^|[^\p{{L}}\p{{N}}])[-\x{{2212}}\x{{2010}}-\x{{2013}}](\d)', '\1' || chr(6) || '\2', 'g'), '[(](\d)', chr(7) || '\1', 'g'),
 '[^\p{{L}}\p{{N}}\x05\x06\x07]', '', 'g'), chr(5) || chr(6) || chr(7), '.-(')"""
_KEYED = f"""
WITH keyed AS (SELECT record_id, {_CANON.format('table_title')} || chr(3) || array_to_string(list_sort(list_filter(list_transform(coalesce("rows", []),
 lambda r: array_to_string(list_sort(list_filter(list_transform(coalesce(r, []), lambda x: {_CANON.format('x')}), lambda y: y <> '')), chr(1))), lambda z: z <> '')), chr(2)) AS key FROM extracted_tables),
grouped AS (SELECT record_id, min(record_id) OVER (PARTITION BY key) AS first_id FROM keyed)"""
P4_FOUND = _KEYED + " SELECT first_id, record_id AS copy_id FROM grouped WHERE first_id <> record_id"
P4_TABLES = _KEYED + " SELECT first_id, count(*) AS copies FROM grouped GROUP BY first_id"

_LINES = r"""
WITH split AS (SELECT chunk_key, chunk_id, ticker, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM chunks),
normal AS (SELECT *, regexp_replace(regexp_replace(lower(line), '\d+', '0', 'g'), '[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+', '', 'g') AS n FROM split),
often AS (SELECT ticker, n FROM normal WHERE ticker IS NOT NULL AND n <> '' GROUP BY ticker, n HAVING count(DISTINCT chunk_id) >= 8),
found AS (SELECT x.chunk_key, x.line_no FROM normal x JOIN often o ON o.ticker = x.ticker AND o.n = x.n)"""
P5_FOUND = _LINES + " SELECT DISTINCT chunk_key, line_no FROM found"
P5_TEXTS = _LINES + """, kept AS (SELECT s.chunk_key, string_agg(s.line, chr(10) ORDER BY s.line_no) FILTER (f.line_no IS NULL) AS text, count(f.line_no) AS n_removed
 FROM split s LEFT JOIN found f ON f.chunk_key = s.chunk_key AND f.line_no = s.line_no GROUP BY s.chunk_key)
SELECT c.chunk_key, CASE WHEN c.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.n_removed, 0) AS n_removed FROM chunks c LEFT JOIN kept k ON k.chunk_key = c.chunk_key"""

P8_FOUND = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE passage IS NOT NULL),
ig AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, k, k + 12), ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 12)) AS k FROM iw)),
dg AS (SELECT doc_id, array_to_string(list_slice(w, k, k + 12), ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS k FROM dw))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""
