"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.plans import query
from ledgerloom.plans import sqltext as S
from ledgerloom.session import table

DOCS = "documents WHERE text IS NOT NULL"


def _docs(spark, d):
    return table(spark, d, "documents").where("text is not null")


@query("t1_normalize_whitespace", f"SELECT doc_id, md5({S.ws('text')}) AS clean FROM {DOCS}")
def t1(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.normalize_whitespace(F.col("text"))).alias("clean"))


@query("t2_word_count", f"SELECT source, count(*) AS docs, CAST(sum({S.wc('text')}) AS BIGINT) AS words FROM {DOCS} GROUP BY source")
def t2(spark, d):
    return _docs(spark, d).groupBy("source").agg(F.count("*").alias("docs"), F.sum(T.word_count(F.col("text"))).alias("words"))


_LINE = f"replace({S.ws('text')}, chr(10), ' ')"


@query("t3_compact_text", f"SELECT doc_id, CASE WHEN length({_LINE}) <= 240 THEN {_LINE} ELSE rtrim(substring({_LINE}, 1, 237)) || '...' END AS preview FROM {DOCS}")
def t3(spark, d):
    return _docs(spark, d).select("doc_id", T.compact_text(F.col("text"), 240).alias("preview"))


_HEAD = "lower(substring(text, 1, 1000))"


_SNIFF = "(contains({0}, '<html') OR contains({0}, '<table') OR contains({0}, '<body'))"
_PAGE = "lower(substring('<HTML><Body class=\"x\">' || text || '</Body></HTML>', 1, 1000))"


@query("t4_html_sniff", f"SELECT doc_id, {_SNIFF.format(_HEAD)} AS as_it_is, {_SNIFF.format(_PAGE)} AS as_a_page FROM {DOCS}")
def t4(spark, d):
    """Whether each text looks like HTML, as it is and set in a page."""
    page = F.concat(F.lit('<HTML><Body class="x">'), F.col("text"), F.lit("</Body></HTML>"))
    return _docs(spark, d).select("doc_id", T.looks_like_html(F.col("text")).alias("as_it_is"), T.looks_like_html(page).alias("as_a_page"))


@query("t5_html_text")
def t5(spark, d):
    from ledgerloom.sources.files import html_to_text

    return _docs(spark, d).select("doc_id", html_to_text(F.col("text")).alias("text"))


_CLEAN = S.ws(r"regexp_replace(translate(text, chr(160), ' '), '-\n([a-z])', '\1', 'g')")


_PAGE_TEXT = S.ws(r"regexp_replace(regexp_replace(regexp_replace('<html><script>let x = 1;</script><body><p>' || text || '</p></body></html>', '(?is)<(script|style|noscript)[^>]*>.*?</(?:script|style|noscript)>', chr(10), 'g'), '<!--.*?-->|<[/!?]?[A-Za-z][^<>]*>', chr(10), 'g'), chr(160), ' ', 'g')")


@query("t5_html_regex", f"SELECT doc_id, md5({_PAGE_TEXT}) AS text FROM {DOCS}")
def t5_regex(spark, d):
    """Texts set in a page and taken out again by patterns alone, entities left as they are."""
    page = F.concat(F.lit("<html><script>let x = 1;</script><body><p>"), F.col("text"), F.lit("</p></body></html>"))
    return _docs(spark, d).select("doc_id", F.md5(T.tags_out(page)).alias("text"))


@query("t6_clean_extracted", f"SELECT doc_id, md5({_CLEAN}) AS clean FROM {DOCS}")
def t6(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.clean_extracted(F.col("text"))).alias("clean"))


@query(
    "t7_filename_metadata",
    r"""
WITH f AS (SELECT DISTINCT source_file, regexp_replace(list_extract(string_split(source_file, '/'), -1), '\.[^.]*$', '') AS stem FROM documents WHERE source_file IS NOT NULL),
p AS (SELECT source_file, list_filter(regexp_split_to_array(stem, '[_\-\s.]+'), lambda x: x <> '') AS parts FROM f),
t AS (SELECT *, list_filter(parts, lambda x: length(regexp_replace(x, '[^A-Za-z]', '', 'g')) BETWEEN 1 AND 6 AND regexp_replace(x, '[^A-Za-z]', '', 'g') = upper(regexp_replace(x, '[^A-Za-z]', '', 'g')) AND lower(x) NOT IN ('form', '10k'))[1] AS tp FROM p)
SELECT source_file, coalesce(regexp_replace(tp, '[^A-Za-z]', '', 'g'), '') AS ticker,
 array_to_string(list_filter(parts, lambda x: x IS DISTINCT FROM tp AND NOT regexp_matches(x, '20\d{2}|19\d{2}') AND lower(x) NOT IN ('form', '10k')), ' ') AS company,
 regexp_extract(array_to_string(parts, ' '), '(20\d{2}|19\d{2})', 1) AS "year" FROM t""",
)
def t7(spark, d):
    files = table(spark, d, "documents").where("source_file is not null").select("source_file").distinct()
    return files.withColumn("m", T.filename_metadata(F.col("source_file"))).select("source_file", "m.ticker", "m.company", "m.year")


@query(
    "t8_sections",
    r"""
WITH m AS (SELECT chunk_key, regexp_replace(text, '(?im)^\s*(Item\s+\d+[A-Z]?)\.?\s+(.{0,100})$', chr(1) || '\1' || chr(2) || '\2' || chr(2), 'g') AS t FROM chunks WHERE text IS NOT NULL),
s AS (SELECT chunk_key, string_split(t, chr(1)) AS parts FROM m),
x AS (SELECT chunk_key, len(parts) AS n, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM s),
y AS (SELECT chunk_key, i, n, CASE WHEN i = 1 THEN CASE WHEN n = 1 THEN 'Unknown' ELSE 'Front Matter' END ELSE 'Item ' || upper(regexp_extract(string_split(p, chr(2))[1], '(?i)Item\s+(\d+[A-Z]?)', 1)) END AS section_id,
 regexp_replace(CASE WHEN i = 1 THEN p ELSE string_split(p, chr(2))[1] || ' ' || string_split(p, chr(2))[2] || string_split(p, chr(2))[3] END, '^\s+|\s+$', '', 'g') AS text FROM x)
SELECT chunk_key, section_id, md5(text) AS text FROM y WHERE NOT (i = 1 AND n > 1 AND text = '')""",
)
def t8(spark, d):
    chunks = table(spark, d, "chunks").where("text is not null")
    return chunks.select("chunk_key", F.explode(T.sections(F.col("text"))).alias("s")).select("chunk_key", "s.section_id", F.md5("s.text").alias("text"))


@query("t9_sentences", f"SELECT doc_id, len({S.sents('text')}) AS sentences, md5(array_to_string({S.sents('text')}, chr(1))) AS joined FROM {DOCS}")
def t9(spark, d):
    s = T.sentences(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(s).cast("long").alias("sentences"), F.md5(F.array_join(s, "\x01")).alias("joined"))


_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_PARAS = r"list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n+'), lambda p: " + _TRIM.format("p") + "), lambda p: p <> '')"
_UNITS = (
    "flatten(list_transform("
    + _PARAS
    + ", lambda p: CASE WHEN "
    + S.wc("p")
    + r" <= 70 THEN [p] ELSE list_filter(list_transform(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(57344), 'g'), chr(57344)), lambda s: "
    + _TRIM.format("s")
    + "), lambda s: s <> '') END))"
)


@query("t10_narrative_units", f"SELECT doc_id, len({_UNITS}) AS units, md5(array_to_string({_UNITS}, chr(1))) AS joined FROM {DOCS}")
def t10(spark, d):
    u = T.narrative_units(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(u).cast("long").alias("units"), F.md5(F.array_join(u, "\x01")).alias("joined"))


@query("t11_limit_words", f"SELECT doc_id, md5(CASE WHEN {S.wc('text')} <= 50 THEN text ELSE array_to_string(list_slice({S.words('text')}, 1, 50), ' ') END) AS start FROM {DOCS}")
def t11(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.limit_words(F.col("text"), 50)).alias("start"))


_TELL = f"list_slice(list_filter({S.sents(_LINE)}, lambda s: regexp_matches(s, '(?i)increased|decreased|primarily|due to|driven by|compared to')), 1, 4)"
_CTX = f"array_to_string({_TELL}, ' ')"


@query("t12_local_context", f"SELECT doc_id, CASE WHEN {S.wc(_CTX)} <= 220 THEN {_CTX} ELSE array_to_string(list_slice({S.words(_CTX)}, 1, 220), ' ') END AS context FROM {DOCS}")
def t12(spark, d):
    return _docs(spark, d).select("doc_id", T.local_context(F.col("text")).alias("context"))


@query(
    "t13_join_series",
    """SELECT pos, CASE len(answer_aliases) WHEN 0 THEN '' WHEN 1 THEN answer_aliases[1]
 ELSE array_to_string(answer_aliases[1:len(answer_aliases) - 1], ', ') || ', and ' || answer_aliases[len(answer_aliases)] END AS series FROM questions_verified WHERE answer_aliases IS NOT NULL""",
)
def t13(spark, d):
    return table(spark, d, "questions_verified").where("answer_aliases is not null").select("pos", T.join_series(F.col("answer_aliases")).alias("series"))


@query("t14_normalize_answer", f"SELECT detail_id, {S.norm('prediction')} AS answer FROM evaluation_details")
def t14(spark, d):
    return table(spark, d, "evaluation_details").select("detail_id", T.normalize_answer(F.col("prediction")).alias("answer"))


@query("n1_numeric_values", f"SELECT detail_id, len({S.nums('prediction')}) AS numbers, round(coalesce(list_max({S.nums('prediction')}), 0), 4) AS largest FROM evaluation_details")
def n1(spark, d):
    v = T.numeric_values(F.col("prediction"))
    return table(spark, d, "evaluation_details").select("detail_id", F.size(v).cast("long").alias("numbers"), F.round(F.coalesce(F.array_max(v), F.lit(0.0)), 4).alias("largest"))


@query("n2_numeric_match", f"SELECT detail_id, {S.near(S.nums('prediction'), S.nums('gold_answer'))} AS matches FROM evaluation_details")
def n2(spark, d):
    m = T.numeric_match(T.numeric_values(F.col("prediction")), T.numeric_values(F.col("gold_answer")))
    return table(spark, d, "evaluation_details").select("detail_id", m.alias("matches"))


_CAND = r"list_transform(list_concat(regexp_extract_all(text, '(?i)(\$?\s*[-+]?\d{1,3}(?:,\d{3})*(?:\.\d+)?\s*(?:billion|million|thousand|bn|mm|m|k)?)'), regexp_extract_all(text, '(?i)([-+]?\d+(?:\.\d+)?\s*(?:%|percent))')), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')))"


@query("n4_candidates", f"WITH c AS (SELECT chunk_key, {_CAND} AS a FROM chunks WHERE text IS NOT NULL) SELECT chunk_key, array_to_string(list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i), '|') AS candidates FROM c")
def n4(spark, d):
    return table(spark, d, "chunks").where("text is not null").select("chunk_key", F.array_join(T.numeric_candidates(F.col("text")), "|").alias("candidates"))
