"""The text functions once more, as fragments of DuckDB SQL."""

from __future__ import annotations

WS = r"[ \t\x0c\x0b]+"


def ws(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), '{WS}', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


def wc(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[^\s\x0b]+'))"


def words(x: str) -> str:
    return rf"regexp_extract_all({x}, '[^\s\x0b]+')"


def sents(x: str) -> str:
    """List of sentences."""
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(57344), 'g'), chr(57344)), lambda s: trim(s)), lambda s: s <> '')"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[$,]', '', 'g'), '[^a-z0-9.\s]', ' ', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"


def nums(x: str) -> str:
    """List of scaled numbers."""
    bare = f"regexp_replace(lower({x}), '[,$]', '', 'g')"
    pat = r"([-+]?\d+(?:\.\d+)?)\s*(billion|million|thousand|bn|mm|m|k)?"
    return (
        f"list_transform(list_zip(regexp_extract_all({bare}, '{pat}', 1), regexp_extract_all({bare}, '{pat}', 2)), lambda z: CAST(z[1] AS DOUBLE) * "
        "CASE WHEN z[2] IN ('billion', 'bn') THEN 1e9 WHEN z[2] IN ('million', 'mm', 'm') THEN 1e6 WHEN z[2] IN ('thousand', 'k') THEN 1e3 ELSE 1.0 END)"
    )


def near(p: str, g: str) -> str:
    """Whether any of the numbers p is near any of the numbers g."""
    return f"len(list_filter({p}, lambda a: len(list_filter({g}, lambda b: abs(a - b) <= greatest(greatest(abs(a), abs(b)) * 0.001, 1.0, abs(b) * 0.001))) > 0)) > 0"


def covered(context: str, evidence: str, answer: str, aliases: str) -> str:
    hay = norm(context)
    return f"len(list_filter(list_transform(list_filter(list_concat([{evidence}, {answer}], coalesce({aliases}, [])), lambda x: x IS NOT NULL), lambda x: {norm('x')}), lambda y: y <> '' AND contains({hay}, y))) > 0"


def refusal(x: str) -> str:
    phrases = "['not enough information', 'cannot determine', 'can''t determine', 'not provided', 'not in the context', 'insufficient information', 'unknown']"
    return f"len(list_filter({phrases}, lambda p: contains({norm(x)}, p))) > 0"
