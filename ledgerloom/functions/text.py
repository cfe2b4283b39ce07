"""Text as Column expressions: cleaning, sentences, sections, answers and numbers. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_BREAK = r"(?<=[.!?])\s+"
# Phrases of a refusal, as they read after normalisation; two never match, which results depend on.
REFUSAL_PHRASES = ("not enough information", "cannot determine", "can't determine", "not provided", "not in the context", "insufficient information", "unknown")
# Words that make a sentence explain a change.
CHANGE_WORDS = "increased|decreased|primarily|due to|driven by|compared to"
# Names of the sections filings are read for.
SECTION_NAMES = {"Item 1": "Business", "Item 1A": "Risk Factors", "Item 7": "Management's Discussion and Analysis", "Item 8": "Financial Statements and Supplementary Data"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often body or its lambdas name it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)


def normalize_whitespace(c: Column) -> Column:
    """Blanks squeezed, lines trimmed, runs of blank lines made one; nothing at either end."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t\f\x0B]+", " ")
    c = F.regexp_replace(c, r" ?\n ?", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^[ \n]+|[ \n]+$", "")


def word_count(c: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_count(c, F.lit(r"\S+"))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\S+)"), F.lit(1))


def compact_text(c: Column, most: int) -> Column:
    """One line of at most ``most`` characters; a longer one ends in three dots."""
    line = F.regexp_replace(normalize_whitespace(c), "\n", " ")
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, most - 3)), F.lit("...")))


def looks_like_html(c: Column) -> Column:
    head = F.lower(F.substring(c, 1, 1000))
    return head.contains("<html") | head.contains("<table") | head.contains("<body")


def tags_out(c: Column) -> Column:
    """Text of a page by patterns: scripts and styles left out, each tag a line break, white space put right; entities stay."""
    c = F.regexp_replace(c, r"(?is)<(script|style|noscript)[^>]*>.*?</(?:script|style|noscript)>", "\n")
    c = F.regexp_replace(c, r"<!--.*?-->|<[/!?]?[A-Za-z][^<>]*>", "\n")
    return normalize_whitespace(F.translate(c, "\u00a0", " "))


def clean_extracted(c: Column) -> Column:
    """Text from a page or file: no-break spaces, hyphens at line ends and white space put right."""
    c = F.translate(c, " ", " ")
    c = F.regexp_replace(c, r"-\n(?=[a-z])", "")
    return normalize_whitespace(c)


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_BREAK), lambda s: F.trim(s)), lambda s: s != "")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n\s*\n+"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def narrative_units(c: Column, keep_words: int = 70) -> Column:
    """Paragraphs, the longer ones as sentences."""
    parts = F.transform(paragraphs(c), lambda p: F.when(word_count(p) <= keep_words, F.array(p)).otherwise(F.filter(F.transform(F.split(p, SENTENCE_BREAK), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")))
    return F.flatten(parts)


def limit_words(c: Column, most: int) -> Column:
    return F.when(word_count(c) <= most, c).otherwise(F.array_join(F.slice(words(c), 1, most), " "))


def local_context(c: Column, most: int = 220) -> Column:
    """The first four sentences that explain a change."""
    flat = F.regexp_replace(normalize_whitespace(c), "\n", " ")
    telling = F.filter(sentences(flat), lambda s: s.rlike(f"(?i){CHANGE_WORDS}"))
    return limit_words(F.array_join(F.slice(telling, 1, 4), " "), most)


def join_series(items: Column) -> Column:
    """"a", "a, and b", "a, b, and c"."""
    n = F.size(items)
    return F.when(n == 0, "").when(n == 1, F.get(items, 0)).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(items, -1)))


def normalize_answer(c: Column) -> Column:
    """Lower case letters, digits and dots, without articles."""
    c = F.regexp_replace(F.lower(c), r"[$,]", "")
    c = F.regexp_replace(c, r"[^a-z0-9.\s]", " ")
    c = F.regexp_replace(c, r"\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def filename_metadata(path: Column) -> Column:
    """struct(ticker, company, year) read off a file's name."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    parts = F.filter(F.split(stem, r"[_\-\s.]+"), lambda p: p != "")
    year = F.regexp_extract(F.array_join(parts, " "), r"(20\d{2}|19\d{2})", 1)
    letters = lambda p: F.regexp_replace(p, "[^A-Za-z]", "")
    is_ticker = lambda p: F.length(letters(p)).between(1, 6) & (letters(p) == F.upper(letters(p))) & ~F.lower(p).isin("form", "10k")
    ticker_part = F.get(F.filter(parts, is_ticker), 0)
    rest = F.filter(parts, lambda p: ~p.eqNullSafe(ticker_part) & ~p.rlike(r"20\d{2}|19\d{2}") & ~F.lower(p).isin("form", "10k"))
    return F.struct(F.coalesce(letters(ticker_part), F.lit("")).alias("ticker"), F.array_join(rest, " ").alias("company"), year.alias("year"))


def sections(c: Column) -> Column:
    """array of struct(section_id, section_name, text): a heading line to the next one; what stands before is front matter."""
    mark, cut = "\u0001", "\u0002"
    marked = F.regexp_replace(c, r"(?im)^\s*(Item\s+\d+[A-Z]?)\.?\s+(.{0,100})$", f"{mark}$1{cut}$2{cut}")
    parts = F.split(marked, mark)

    def named(p: Column) -> Column:
        bits = F.split(p, cut)
        raw = F.get(bits, 0)
        sid = F.concat(F.lit("Item "), F.upper(F.regexp_extract(raw, r"(?i)Item\s+(\d+[A-Z]?)", 1)))
        tail = F.trim(F.get(bits, 1))
        known = F.create_map(*[F.lit(x) for kv in SECTION_NAMES.items() for x in kv])
        name = F.coalesce(known[sid], F.nullif(tail, F.lit("")), sid)
        return F.struct(sid.alias("section_id"), name.alias("section_name"), F.regexp_replace(F.concat(raw, F.lit(" "), F.get(bits, 1), F.get(bits, 2)), r"^\s+|\s+$", "").alias("text"))

    front = F.regexp_replace(F.get(parts, 0), r"^\s+|\s+$", "")
    alone = F.array(F.struct(F.lit("Unknown").alias("section_id"), F.lit("Unknown").alias("section_name"), front.alias("text")))
    before = F.when(front != "", F.array(F.struct(F.lit("Front Matter").alias("section_id"), F.lit("Front Matter").alias("section_name"), front.alias("text")))).otherwise(F.filter(alone, lambda x: F.lit(False)))
    return F.when(F.size(parts) == 1, alone).otherwise(F.concat(before, F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), named)))


def numeric_values(c: Column) -> Column:
    """Numbers of a text times the scale word or letter behind them; none of a null."""
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[,$]", "")
    pattern = r"([-+]?\d+(?:\.\d+)?)\s*(billion|million|thousand|bn|mm|m|k)?"
    numbers, scales = (F.regexp_extract_all(bare, F.lit(pattern), F.lit(g)) for g in (1, 2))
    scale = lambda s: F.when(s.isin("billion", "bn"), 1e9).when(s.isin("million", "mm", "m"), 1e6).when(s.isin("thousand", "k"), 1e3).otherwise(1.0)
    return F.zip_with(numbers, scales, lambda n, s: n.cast("double") * scale(s))


def numeric_match(predicted: Column, gold: Column, tolerance: float = 1e-3) -> Column:
    """Whether any number of one list is near any of the other; near is a part in a thousand, and 1 at least."""
    near = lambda p, g: F.abs(p - g) <= F.greatest(F.greatest(F.abs(p), F.abs(g)) * tolerance, F.lit(1.0), F.abs(g) * tolerance)
    return let(gold, lambda gs: F.exists(predicted, lambda p: F.exists(gs, lambda g: near(p, g))))


def numeric_candidates(c: Column) -> Column:
    """Amounts, then percentages, of a text as written; repeats left out whatever their case."""
    money = F.regexp_extract_all(c, F.lit(r"(?i)(\$?\s*[-+]?\d{1,3}(?:,\d{3})*(?:\.\d+)?\s*(?:billion|million|thousand|bn|mm|m|k)?)"), F.lit(1))
    percent = F.regexp_extract_all(c, F.lit(r"(?i)([-+]?\d+(?:\.\d+)?\s*(?:%|percent))"), F.lit(1))
    all_ = F.transform(F.concat(money, percent), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return let(all_, lambda a: let(F.transform(a, lambda x: F.lower(x)), lambda seen: F.filter(a, lambda x, i: F.array_position(seen, F.lower(x)) == i + 1)))


def is_refusal(c: Column) -> Column:
    return let(normalize_answer(c), lambda norm: F.exists(F.array(*map(F.lit, REFUSAL_PHRASES)), lambda p: F.contains(norm, p)))


def exact_match(prediction: Column, answers: Column) -> Column:
    return let(normalize_answer(prediction), lambda p: F.exists(answers, lambda a: normalize_answer(a) == p))


def token_f1(prediction: Column, answers: Column) -> Column:
    """Best F1 of the answers over words counted with repeats; 1 where both are empty, 0 without answers."""
    tokens = lambda x: F.filter(F.split(normalize_answer(x), " "), lambda t: t != "")
    times = lambda a, t: F.size(F.filter(a, lambda x: x == t))

    def one(pred: Column, gold: Column) -> Column:
        shared = F.aggregate(F.array_distinct(pred), F.lit(0), lambda n, t: n + F.least(times(pred, t), times(gold, t)))

        def f1(n: Column) -> Column:
            p, r = n / F.size(pred), n / F.size(gold)
            return F.when((F.size(pred) == 0) & (F.size(gold) == 0), 1.0).when(n == 0, 0.0).otherwise(2 * p * r / (p + r))

        return let(shared, f1)

    best = let(tokens(prediction), lambda pred: F.array_max(F.transform(answers, lambda a: let(tokens(a), lambda gold: one(pred, gold)))))
    return F.coalesce(best, F.lit(0.0))


def answer_coverage(context: Column, evidence: Column, answer: Column, aliases: Column) -> Column:
    """Whether evidence, answer or an alias stands in the context, all normalised."""
    cands = F.concat(F.array(evidence, answer), F.coalesce(aliases, F.array().cast("array<string>")))
    norms = F.transform(F.filter(cands, lambda x: x.isNotNull()), normalize_answer)
    return let(normalize_answer(context), lambda hay: F.exists(norms, lambda x: (x != "") & F.contains(hay, x)))
