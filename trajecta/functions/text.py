"""Vocabulary matching, question parsing, citations and sentence pieces."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

#: ``[id @ H:MM:SS]``, several ids-with-times may share the brackets' sentence.
CITATION = r"\[([A-Za-z0-9_\-]+)\s*@\s*(\d{1,2}:\d{2}:\d{2})\]"


def _any(phrases: list[str], plural: bool = False) -> str:
    """One pattern for any of the phrases as whole words."""
    tail = "(?:e?s)?" if plural else ""
    return r"\b(?:" + "|".join(re.escape(p).replace(r"\-", "-").replace(r"\ ", " ") + tail for p in phrases) + r")\b"


def match_vocabulary(text: Column, vocabulary: dict[str, list[str]], *, plural: bool = False) -> Column:
    """The first canonical value, in vocabulary order, with a form in the text."""
    low, found = F.lower(text), F.lit(None).cast("string")
    for value, forms in reversed(vocabulary.items()):
        found = F.when(low.rlike(_any(forms, plural)), F.lit(value)).otherwise(found)
    return found


def normalize_value(value: Column, attribute: str) -> Column:
    """A raw reading as a canonical value, or null where it is none; ``model``
    has no vocabulary and is only trimmed and lower-cased."""
    v = F.nullif(F.lower(F.trim(value)), F.lit(""))
    if attribute == "model":
        return v
    vocabulary = V.ATTRIBUTES[attribute]
    return F.when(v.isin(*vocabulary), v).otherwise(match_vocabulary(v, vocabulary))


def find_all(text: Column, vocabulary: dict[str, list[str]], *, plural: bool = True) -> Column:
    """All canonical values with a form in the text, in vocabulary order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(_any(forms, plural)), F.lit(v)) for v, forms in vocabulary.items()]))


def has_marker(text: Column, markers: list[str]) -> Column:
    return F.lower(text).rlike(_any(markers))


def question_type(text: Column) -> Column:
    """counting before counterfactual before forecast, else factual."""
    return F.when(has_marker(text, V.COUNTING), "counting").when(has_marker(text, V.COUNTERFACTUAL), "counterfactual").when(has_marker(text, V.FORECAST), "forecast").otherwise("factual")


def split_at_relation(text: Column, phrases: list[str] = V.EVENTS["OVERTAKE"]) -> tuple[Column, Column]:
    """(before, after) the relation phrase that ends first."""
    low = F.lower(text)
    ends = F.array_compact(F.array(*[F.when(low.rlike(_any([p])), F.regexp_instr(low, F.lit(_any([p]))) + len(p)) for p in phrases]))
    end = F.array_min(ends)
    return F.when(end.isNull(), low).otherwise(F.substring(low, F.lit(1), end - 1)), F.when(end.isNull(), F.lit("")).otherwise(F.substring(low, end, F.length(low)))


def citations(text: Column) -> Column:
    """array of (id, at) in order, repeats kept; times as HH:MM:SS."""
    ids, times = (F.regexp_extract_all(text, F.lit(CITATION), F.lit(i)) for i in (1, 2))
    return F.zip_with(ids, times, lambda i, t: F.struct(i.alias("id"), F.lpad(t, 8, "0").alias("at")))


def time_of(iso: Column) -> Column:
    """The time of day of an ISO timestamp, without its fraction."""
    return F.split_part(F.element_at(F.split(iso, "T"), -1), F.lit("."), F.lit(1))


def pluralize(noun: Column, n: Column) -> Column:
    plural = F.when(noun == "person", "people").when(noun == "bus", "buses").otherwise(F.concat(noun, F.lit("s")))
    return F.when(n == 1, noun).otherwise(plural)


def article(phrase: Column) -> Column:
    return F.concat(F.when(F.lower(phrase).rlike("^[aeiou]"), "an ").otherwise("a "), phrase)


#: Phrases by which an answer says that it cannot tell.
ABSTENTIONS = (
    "insufficient evidence", "not enough information", "cannot determine", "can't determine", "cannot answer", "can't answer", "unable to determine", "no information", "not possible to",
    "not specified", "not mentioned", "does not contain", "does not specify", "does not mention", "not provided", "no evidence", "not available in the",
)


def is_abstention(answer: Column) -> Column:
    return F.lower(answer).rlike("|".join(ABSTENTIONS))


def first_count(text: Column) -> Column:
    """The first number, in digits or in words up to twenty."""
    low = F.lower(text)
    found = F.regexp_extract(low, r"\b(\d+|" + "|".join(sorted(V.NUMBER_WORDS, key=lambda w: (-len(w), w))) + r")\b", 1)
    words = F.create_map(*[x for w, n in V.NUMBER_WORDS.items() for x in (F.lit(w), F.lit(n))])
    return F.when(found.rlike(r"^\d+$"), found.cast("int")).otherwise(F.try_element_at(words, found))


_LATEX = {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"} | {c: "\\" + c for c in "&%$#_{}"}


def latex_escape(text: str) -> str:
    """For report cells."""
    return "".join(_LATEX.get(c, c) for c in text)


def latex_escaped(text: Column) -> Column:
    """``latex_escape`` of a column, character by character."""
    table = F.create_map(*[F.lit(x) for c, t in _LATEX.items() for x in (c, t)])
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
