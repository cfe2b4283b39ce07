"""Queries over the chunking operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import chunking as C
from ledgerloom.plans import query
from ledgerloom.plans import sqltext as S
from ledgerloom.session import table


def _fixed_sql(config: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"""SELECT doc_id, '{config}' AS chunk_config, k AS chunk_index, md5(array_to_string(list_slice(w, k * {step} + 1, k * {step} + {size}), ' ')) AS text, len(list_slice(w, k * {step} + 1, k * {step} + {size})) AS token_count
 FROM (SELECT doc_id, w, unnest(generate_series(0, CAST(greatest(ceil((len(w) - {size}) / {step}.0), 0) AS BIGINT))) AS k FROM w)"""


@query("c3_fixed_chunks", f"WITH w AS (SELECT * FROM (SELECT doc_id, {S.words(S.ws('text'))} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0) " + " UNION ALL ".join(_fixed_sql(c, n, o) for c, (k, n, o) in C.CONFIGS.items() if k == "fixed"))
def c3(spark, d):
    """All fixed windows of all documents, for each configuration of that kind."""
    out = None
    for name, (kind, size, overlap) in C.CONFIGS.items():
        if kind == "fixed":
            one = C.fixed_windows(table(spark, d, "documents"), "doc_id", "text", name, size, overlap)
            out = one if out is None else out.unionByName(one)
    return out.withColumn("text", F.md5("text"))


@query("c4_section_chunks")
def c4(spark, d):
    return C.section_chunks(table(spark, d, "chunks").where("text is not null"), "chunk_key", "text")


@query("c5_greedy_pack")
def c5(spark, d):
    return C.narrative_chunks(table(spark, d, "documents").where("text is not null"), "doc_id", "text")


def _filings(spark, d):
    """Extracted tables as the text of a page: title, then rows of cells."""
    t = table(spark, d, "extracted_tables").where("rows is not null")
    lines = F.transform("rows", lambda r: F.array_join(r, " "))
    return t.select("record_id", "year", F.concat_ws("\n", F.col("table_title"), F.array_join(lines, "\n")).alias("text"))


_NUM = r"\$?\(?-?\d[\d,]*(?:\.\d+)?\)?\s*%?"
_ROWS_SQL = (
    r"""
WITH f AS (SELECT record_id, "year", concat_ws(chr(10), table_title, array_to_string(list_transform("rows", lambda r: array_to_string(r, ' ')), chr(10))) AS text FROM extracted_tables WHERE "rows" IS NOT NULL),
l0 AS (SELECT record_id, "year", CASE WHEN contains(lower(text), 'in millions') THEN 'dollars in millions' WHEN contains(lower(text), 'in billions') THEN 'dollars in billions' WHEN contains(lower(text), 'percent') THEN 'percent' ELSE '' END AS units,
 unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS raw, generate_subscripts(regexp_split_to_array(text, '\r\n|\n|\r'), 1) - 1 AS line_no FROM f),
l AS (SELECT *, """
    + S.ws("raw")
    + r""" AS line FROM l0),
m AS (SELECT *, regexp_extract_all(line, '\b(20\d{2}|19\d{2})\b', 1) AS ys, regexp_extract_all(line, '"""
    + _NUM
    + r"""') AS ns, CASE WHEN line <> '' AND regexp_matches(line, '[A-Za-z]') AND """
    + S.wc("line")
    + r""" <= 14 THEN line END AS can FROM l),
n AS (SELECT *, coalesce(lag(can, 1) OVER w, lag(can, 2) OVER w, lag(can, 3) OVER w, lag(can, 4) OVER w, lag(can, 5) OVER w, 'Financial table') AS nearest, line <> '' AND len(ys) >= 2 AS header FROM m WINDOW w AS (PARTITION BY record_id ORDER BY line_no)),
o AS (SELECT *, line <> '' AND NOT header AND (len(ns) < 2 OR NOT regexp_matches(line, '[A-Za-z]')) AS plain FROM n),
p AS (SELECT *, CASE WHEN header AND line_no > 0 THEN nearest WHEN plain AND regexp_matches(line, '[A-Za-z]') AND """
    + S.wc("line")
    + r""" <= 16 THEN line END AS te, CASE WHEN header THEN list_slice(ys, 1, 5) END AS he FROM o),
q AS (SELECT *, last_value(te IGNORE NULLS) OVER w AS title, last_value(he IGNORE NULLS) OVER w AS head FROM p WINDOW w AS (PARTITION BY record_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, regexp_replace("""
    + S.ws("regexp_replace(substring(line, 1, position(ns[1] IN line) - 1), '[$()]', '', 'g')")
    + r""", '^[ .:\-]+|[ .:\-]+$', '', 'g') AS row_label FROM q WHERE line <> '' AND NOT header AND NOT plain),
s AS (SELECT *, list_slice(ns, 1, CASE WHEN len(head) > 0 THEN len(head) ELSE least(3, len(ns)) END) AS vals FROM r WHERE row_label <> '' AND length(row_label) <= 90),
rows_ AS (SELECT record_id, line_no, row_label, coalesce(title, nearest) AS table_title, vals AS "values", CASE WHEN len(head) > 0 THEN list_slice(head, 1, len(vals))
 ELSE list_transform(generate_series(0, len(vals) - 1), lambda i: CAST(CASE WHEN coalesce(TRY_CAST("year" AS INT), 0) > 0 THEN TRY_CAST("year" AS INT) - i ELSE i + 1 END AS VARCHAR)) END AS years, units FROM s)"""
)


def _rows(spark, d):
    return C.table_rows(_filings(spark, d), "record_id", "text", F.col("year")).withColumn("line_no", F.col("line_no").cast("long"))


@query("c8_table_rows", _ROWS_SQL + """ SELECT record_id, line_no, row_label, table_title, array_to_string("values", '|') AS "values", array_to_string(years, '|') AS years, units FROM rows_""")
def c8(spark, d):
    return _rows(spark, d).withColumns({c: F.array_join(c, "|") for c in ("values", "years")})


def _inline_sql() -> str:
    figure, share = r"\s+\$?\s*([\d,]+(?:\.\d+)?)", r"(?:\s+\(?-?\d+\)?\s*%|\s+—\s*%)?"
    flat = f"replace({S.ws('text')}, chr(10), ' ')"
    parts = []
    for label in C.INLINE_LABELS:
        pat = rf"(?i)(?:^|[^A-Za-z])({label})(?:\s*\(\d+\))?{figure}{share}{figure}{share}{figure}"
        parts.append(f"SELECT record_id, t, y, unnest(list_zip({', '.join(f'regexp_extract_all(t, $x${pat}$x$, {g})' for g in range(1, 5))})) AS z FROM t")
    title = "CASE " + " ".join(f"WHEN contains(lower(t), '{x.lower()}') THEN '{x}'" for x in C.INLINE_TITLES) + " ELSE 'Financial table' END"
    found = r"regexp_extract_all(t, '\b(20\d{2}|19\d{2})\b', 1)"
    trios = f"list_filter(list_transform(generate_series(1, len({found}) - 2), lambda i: list_slice({found}, i, i + 2)), lambda w: CAST(w[1] AS INT) - 1 = CAST(w[2] AS INT) AND CAST(w[2] AS INT) - 1 = CAST(w[3] AS INT))[1]"
    years = f"coalesce({trios}, CASE WHEN y IS NOT NULL THEN [CAST(y AS VARCHAR), CAST(y - 1 AS VARCHAR), CAST(y - 2 AS VARCHAR)] END, CASE WHEN len({found}) > 0 THEN list_slice({found}, 1, 3) END, {list(C.NO_YEARS)})"
    return f"WITH t AS (SELECT record_id, TRY_CAST(\"year\" AS INT) AS y, {flat} AS t FROM (SELECT record_id, \"year\", array_to_string(list_transform(\"rows\", lambda r: array_to_string(r, ' ')), chr(10)) AS text FROM extracted_tables WHERE \"rows\" IS NOT NULL)) SELECT record_id, z[1] AS row_label, concat_ws('|', z[2], z[3], z[4]) AS \"values\", {title} AS table_title, array_to_string({years}, '|') AS years FROM ({' UNION ALL '.join(parts)})"


@query("c9_inline_rows", _inline_sql())
def c9(spark, d):
    t = table(spark, d, "extracted_tables").where("rows is not null")
    lines = t.select("record_id", "year", F.array_join(F.transform("rows", lambda r: F.array_join(r, " ")), "\n").alias("text"))
    return C.inline_rows(lines, "record_id", "text", F.col("year")).withColumns({c: F.array_join(c, "|") for c in ("values", "years")})


@query("c10_row_dedupe", _ROWS_SQL + ' SELECT record_id, line_no, row_label FROM (SELECT *, row_number() OVER (PARTITION BY record_id, lower(row_label), "values" ORDER BY line_no) AS n FROM rows_) WHERE n = 1')
def c10(spark, d):
    return C.distinct_rows(_rows(spark, d), "record_id").select("record_id", "line_no", "row_label")


@query(
    "c11_table_summaries",
    _ROWS_SQL
    + """, g AS (SELECT record_id, list(struct_pack(a := line_no, b := table_title, c := row_label, d := regexp_matches(row_label, '(?i)total|net sales|revenue|income|cash')) ORDER BY line_no) AS r FROM rows_ GROUP BY record_id)
SELECT record_id, r[1].b AS table_title, array_to_string(list_transform(list_slice(CASE WHEN len(list_filter(r, lambda x: x.d)) > 0 THEN list_filter(r, lambda x: x.d) ELSE r END, 1, 5), lambda x: x.c), ', ') AS labels FROM g""",
)
def c11(spark, d):
    return C.table_summaries(_rows(spark, d), "record_id")


_BARE_FIGURE = r"trim(regexp_replace(trim(v), '[$,%)]', '', 'g'))"
_X = rf"CASE WHEN regexp_full_match({_BARE_FIGURE}, '[-(]?(\d+(\.\d*)?|\.\d+)') THEN CAST(regexp_replace({_BARE_FIGURE}, '^[-(]', '') AS DOUBLE) * CASE WHEN regexp_matches({_BARE_FIGURE}, '^[-(]') THEN -1 ELSE 1 END END"
_SAID = f"""list_transform("values", lambda v: CASE WHEN ({_X}) IS NULL THEN trim(v) WHEN contains(v, '%') OR contains(units, 'percent') THEN printf('%g', {_X}) || '%'
 WHEN contains(units, 'millions') THEN CASE WHEN abs({_X}) >= 1000 THEN '$' || printf('%.3f', ({_X}) / 1000) || ' billion ($' || format('{{:,.0f}}', {_X}) || ' million)' ELSE '$' || printf('%g', {_X}) || ' million' END
 WHEN contains(units, 'billions') THEN '$' || printf('%g', {_X}) || ' billion' ELSE trim(v) END)"""
_C12 = (
    _ROWS_SQL
    + f""", sd AS (SELECT *, {_SAID} AS said, list_transform("values", lambda v: trim(regexp_replace(v, '[$,]', '', 'g'))) AS bare FROM rows_),
it AS (SELECT sd.*, t.company, t.ticker, t."year" AS y, list_transform(generate_series(1, least(len(said), len(years))), lambda i: said[i] || ' in ' || years[i]) AS items,
 list_filter(flatten(list_transform(generate_series(1, len(said)), lambda i: [said[i], CASE WHEN bare[i] <> '' THEN trim(bare[i] || ' ' || units) END])), lambda x: x IS NOT NULL AND x <> '') AS al FROM sd JOIN extracted_tables t USING (record_id))
SELECT record_id, line_no, coalesce(nullif(company, ''), nullif(ticker, ''), 'Company') || CASE WHEN coalesce(ticker, '') <> '' THEN ' (' || ticker || ')' ELSE '' END || ' fiscal ' || coalesce(y, years[1], '') || ' ' || table_title || ' table. '
 || CASE WHEN lower(row_label) = 'services' AND contains(lower(table_title), 'products and services') THEN 'Services net sales' WHEN lower(row_label) = 'products' AND NOT contains(lower(table_title), 'gross margin') THEN 'Products net sales' ELSE row_label END
 || ' were ' || CASE WHEN len(items) = 0 THEN '' WHEN len(items) = 1 THEN items[1] ELSE array_to_string(list_slice(items, 1, len(items) - 1), ', ') || ', and ' || items[len(items)] END || CASE WHEN units <> '' THEN ' (' || units || ')' ELSE '' END || '.' AS text,
 array_to_string(list_filter(al, lambda x, i: list_position(al, x) = i), '|') AS value_aliases FROM it"""
)


@query("c12_row_texts", _C12)
def c12(spark, d):
    """Table rows as sentences, with their figures formatted and their aliases."""
    t = table(spark, d, "extracted_tables").select("record_id", "company", "ticker", "year")
    rows = _rows(spark, d).withColumn("formatted", C.financial_values(F.col("values"), F.col("units"))).join(t, "record_id")
    said = C.natural_text(*(F.col(c) for c in ("company", "ticker", "year", "table_title", "row_label", "formatted", "years", "units")))
    return rows.select("record_id", "line_no", said.alias("text"), F.array_join(C.value_aliases(F.col("values"), F.col("formatted"), F.col("units")), "|").alias("value_aliases"))


@query("c14_units", "SELECT chunk_key, CASE WHEN contains(lower(text), 'in millions') THEN 'dollars in millions' WHEN contains(lower(text), 'in billions') THEN 'dollars in billions' WHEN contains(lower(text), 'percent') THEN 'percent' ELSE '' END AS units FROM chunks WHERE text IS NOT NULL")
def c14(spark, d):
    return table(spark, d, "chunks").where("text is not null").select("chunk_key", C.infer_units(F.col("text")).alias("units"))


_LOW = f"lower({S.ws('text')})"
_TOC = f"(contains({_LOW}, 'table of contents') OR (len(regexp_extract_all({_LOW}, '\\bitem\\s+\\d+[a-z]?\\b')) >= 4 AND " + " + ".join(f"CAST(contains({_LOW}, '{t.replace(chr(39), chr(39) * 2)}') AS INT)" for t in C.CONTENTS_TERMS) + " >= 2))"
_REASON = f"""CASE WHEN {S.wc('text')} < 8 THEN 'too_short' WHEN section_id = 'Front Matter' THEN 'cover_page'
 WHEN starts_with(coalesce(source_type, ''), 'table') AND coalesce(section_id, '') NOT IN ('Item 7', 'Item 8') THEN 'navigation_only' WHEN contains({_LOW}, '/mnt/data/') THEN 'header_footer' WHEN {_TOC} THEN 'table_of_contents'
 WHEN contains({_LOW}, 'signature') AND {S.wc('text')} < 120 THEN 'signatures' WHEN contains({_LOW}, 'exhibit index') OR contains({_LOW}, 'exhibit and financial statement schedules') THEN 'exhibit_list'
 WHEN contains({_LOW}, 'forward-looking statements') OR contains({_LOW}, 'forward looking statements') THEN 'forward_looking_boilerplate' WHEN {' OR '.join(f"contains({_LOW}, '{p}')" for p in C.BOILERPLATE)} THEN 'navigation_only' END"""


@query("c17_retrievability", f"SELECT chunk_key, {_REASON} AS reason FROM chunks WHERE text IS NOT NULL")
def c17(spark, d):
    why = C.retrievability_reason(F.col("text"), F.col("section_id"), F.col("source_type"), aggressive=True)
    return table(spark, d, "chunks").where("text is not null").select("chunk_key", why.alias("reason"))


_STEM = r"regexp_replace(list_extract(string_split(coalesce(source_file, 'document'), '/'), -1), '\.[^.]*$', '')"


@query(
    "c18_chunk_ids",
    f"""SELECT chunk_key, concat_ws('_', coalesce(nullif(ticker, ''), 'UNK'), coalesce(nullif("year", ''), 'YYYY'), substring(regexp_replace(regexp_replace({_STEM}, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 30),
 substring(md5(coalesce(source_file, {_STEM})), 1, 8), coalesce(source_type, 'chunk'), printf('%04d', chunk_index)) AS id FROM chunks WHERE chunk_index IS NOT NULL""",
)
def c18(spark, d):
    base = C.base_id(F.col("source_file"), F.col("ticker"), F.col("year"))
    return table(spark, d, "chunks").where("chunk_index is not null").select("chunk_key", F.concat_ws("_", base, F.coalesce("source_type", F.lit("chunk")), F.format_string("%04d", "chunk_index")).alias("id"))


@query("c19_finalized", f"""WITH r AS (SELECT *, {_REASON} AS reason FROM chunks WHERE text IS NOT NULL) SELECT chunk_key, CASE WHEN chunk_config IS NULL OR contains(chunk_id, chunk_config) THEN chunk_id ELSE chunk_id || '_' || chunk_config END AS chunk_id,
 CASE WHEN reason IS NOT NULL THEN FALSE ELSE coalesce(retrievable, TRUE) END AS retrievable, reason AS non_retrievable_reason FROM r""")
def c19(spark, d):
    return C.finalized(table(spark, d, "chunks").where("text is not null"), aggressive=True).select("chunk_key", "chunk_id", "retrievable", "non_retrievable_reason")


@query("c20_chunk_stats", "SELECT chunk_config, source_type, retrievable, count(*) AS chunks, round(avg(token_count), 6) AS mean_words FROM chunks GROUP BY GROUPING SETS ((), (chunk_config), (source_type), (retrievable))")
def c20(spark, d):
    table(spark, d, "chunks").createOrReplaceTempView("ledgerloom_chunks")
    return spark.sql("SELECT chunk_config, source_type, retrievable, count(*) AS chunks, round(avg(token_count), 6) AS mean_words FROM ledgerloom_chunks GROUP BY GROUPING SETS ((), (chunk_config), (source_type), (retrievable))")


_DIMS = ["chunk_config", "company", "section_id", "source_type", "non_retrievable_reason", "retrievable"]


@query("c21_chunk_audit", "SELECT 'total' AS category, 'all' AS value, count(*) AS count FROM chunks UNION ALL " + " UNION ALL ".join(f"SELECT '{x}', coalesce(CAST({x} AS VARCHAR), 'unknown'), count(*) FROM chunks GROUP BY 2" for x in _DIMS))
def c21(spark, d):
    return C.audit(table(spark, d, "chunks"))


@query("c22_not_retrievable", "SELECT chunk_key, non_retrievable_reason, substring(text, 1, 240) AS preview FROM chunks WHERE NOT retrievable")
def c22(spark, d):
    return table(spark, d, "chunks").where("not retrievable").select("chunk_key", "non_retrievable_reason", F.substring("text", 1, 240).alias("preview"))


@query(
    "c23_samples",
    """SELECT chunk_key, kind, n FROM (SELECT chunk_key, source_type AS kind, row_number() OVER (PARTITION BY source_type ORDER BY chunk_key) AS n FROM chunks) WHERE n <= 5
UNION ALL SELECT chunk_key, 'not retrievable', n FROM (SELECT chunk_key, row_number() OVER (ORDER BY chunk_key) AS n FROM chunks WHERE NOT retrievable) WHERE n <= 5""",
)
def c23(spark, d):
    """The first five chunks of each type and of those that can't be retrieved: a report."""
    chunks = table(spark, d, "chunks").select("chunk_key", "source_type", "retrievable")
    kinds = C.samples(chunks.withColumn("kind", F.col("source_type")), "kind", "chunk_key").select("chunk_key", "kind", "n")
    lost = C.samples(chunks.where("not retrievable").withColumn("kind", F.lit("not retrievable")), "kind", "chunk_key").select("chunk_key", "kind", "n")
    return kinds.unionByName(lost)


@query("c13_context_addon", "SELECT DISTINCT source_file FROM chunks WHERE source_file IS NOT NULL AND source_file NOT IN (SELECT source_file FROM chunks WHERE source_type = 'local_context' AND source_file IS NOT NULL)")
def c13(spark, d):
    """Files that have no local context yet, and would get some."""
    chunks = table(spark, d, "chunks").where("source_file is not null")
    return chunks.select("source_file").distinct().join(chunks.where("source_type = 'local_context'").select("source_file"), "source_file", "left_anti")


def _built(spark, d, *configs):
    docs = table(spark, d, "chunks").select("chunk_key", "text", "source_file", "ticker", "company", "year")
    out = None
    for c in configs:
        one = C.build_chunks(docs, "chunk_key", c)
        out = one if out is None else out.unionByName(one)
    return out


@query("c6_mixed_chunks")
def c6(spark, d):
    """The default configuration over texts with headings, figures and prose."""
    return _built(spark, d, "table_aware_mixed")


@query("c7_all_configs")
def c7(spark, d):
    """Chunks by configuration and kind, for all eight."""
    return _built(spark, d, *C.CONFIGS).groupBy("chunk_config", "source_type", "retrievable").agg(F.count("*").alias("chunks"))


@query("c13_local_contexts")
def c13_contexts(spark, d):
    """Every local context of the configuration that adds some to documents without any."""
    return _built(spark, d, "table_aware_clean_context").where("source_type = 'local_context'").select("chunk_key", "section_id", "chunk_index", F.md5("text").alias("text"))
