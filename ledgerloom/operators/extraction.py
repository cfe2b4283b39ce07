"""Numeric answers read out of retrieved texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as T


# Millions that a scale word or letter stands for; a bare figure counts millions.
IN_MILLIONS = {"billion": 1000.0, "bn": 1000.0, "million": 1.0, "mm": 1.0, "m": 1.0, "thousand": 0.001, "k": 0.001, "": 1.0}
_PHRASE = re.compile(r"([-+]?\d+(?:\.\d+)?)\s*(%|percent|billion|million|thousand|bn|mm|m|k)?")


def normalized_phrase(text: str) -> str:
    """A figure as "x percent" or "x million"; a text without one as it is, in lower case. A share anywhere goes before an amount."""
    plain = text.lower().replace(",", "").replace("$", "").strip()
    figures = _PHRASE.findall(plain)
    share = next((n for n, unit in figures if unit in ("%", "percent")), None)
    if share is not None:
        return f"{float(share):g} percent"
    return f"{float(figures[0][0]) * IN_MILLIONS[figures[0][1]]:g} million" if figures else plain


def normalized_phrases(c: Column) -> Column:
    """:func:`normalized_phrase` of a column; Java has no %g."""

    @F.pandas_udf("string")
    def say(v: pd.Series) -> pd.Series:
        return v.map(normalized_phrase, na_action="ignore")

    return say(c)


def extract_answers(texts: DataFrame, questions: DataFrame, key: str, kinds: tuple[str, ...] = ("numeric_fact",)) -> DataFrame:
    """(key, answer, place, method) of each key's best text, for questions of some kinds; texts has key, question_id, place and text, questions one row an id.

    Texts with the question's row label come first. A text that holds an alias of the answer gives the alias;
    else the first text with figures gives the figure near an alias, or its first one.
    """
    q = questions.select("question_id", F.coalesce("row_label", F.lit("")).alias("_label"), F.filter(F.concat(F.array("answer", "normalized_answer"), F.coalesce("answer_aliases", F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != "")).alias("_aliases"), "question_type")
    j = texts.where("text is not null").join(q, "question_id").where(F.col("question_type").isin(*kinds))
    labelled = F.contains(F.lower("text"), F.lower("_label"))
    gold = F.flatten(F.transform("_aliases", T.numeric_values))
    j = j.withColumns({"_hit": labelled, "_alias": T.let(T.normalize_answer(F.col("text")), lambda norm: F.get(F.filter("_aliases", lambda a: F.contains(norm, T.normalize_answer(a))), 0)), "_cands": T.numeric_candidates(F.col("text")), "_gold": gold})
    j = j.withColumn("_near", F.get(F.filter("_cands", lambda c: T.numeric_match(T.numeric_values(c), F.col("_gold"))), 0))
    usable = ((F.col("_label") == "") | F.col("_hit")) & (F.size("_cands") > 0)
    turn = F.when(F.col("_alias").isNotNull(), 1).when(usable, 2)
    answer = F.when(F.col("_alias").isNotNull(), F.col("_alias")).otherwise(F.coalesce("_near", F.get("_cands", 0)))
    method = F.when(F.col("_alias").isNotNull(), "alias_match").when(F.col("_near").isNotNull(), "normalized_numeric_match").otherwise("first_numeric_candidate")
    order = F.struct(turn, F.when((F.col("_label") != "") & F.col("_hit"), 0).otherwise(1), F.col("place"))
    return j.where(turn.isNotNull()).groupBy(key).agg(F.min_by(F.struct(answer.alias("answer"), "place", method.alias("method")), order).alias("_b")).select(key, "_b.*")
