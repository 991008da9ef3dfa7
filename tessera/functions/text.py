"""Text functions as column expressions. Blank means ASCII white space, as in the patterns below."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of pages and blocks that carry no content.
PARSER_NOISE = [r"(?i)THIS\s+PAGE\s+INTENTIONALLY\s+LEFT\s+BLANK", r"(?i)^\s*Page\s+\d+\s*(?:of\s+\d+)?\s*$", r"^\s*\d+\s*$", r"^[-=_]{10,}$"]
CHUNK_NOISE = [
    r"(?i)DISTRIBUTION\s+(?:AUTHORIZED|LIMITED|STATEMENT)",
    r"(?i)THIS\s+PAGE\s+INTENTIONALLY\s+LEFT\s+BLANK",
    r"(?i)FOR\s+OFFICIAL\s+USE\s+ONLY",
    r"(?i)^\s*Page\s+\d+\s*(?:of\s+\d+)?\s*$",
]
# Entity patterns of descriptions.
SCREEN_CODE = r"(?i)\b(?:screen|form|window)\s*(\d{3}[A-Z]?)\b"
EQUIPMENT_CODE = r"\b[A-Z]{2,5}-\d{3,}\b"
PROCEDURE = r"(?i)\b(?:step|procedure|process|task)\s+\d+"
FIELD_LABEL = r"(?:field|column|label)[:\s]+[\"']?([A-Z][A-Za-z /]{2,30})[\"']?"
# Fixed value: a query that needs outside facts.
FACTUAL = (
    r"(?i)\b(\d{4}|\d{1,2}/\d{1,2}|\bwhen\b|\bwhere\b|\bwho\b|\bhow many\b|\bwhat is\b|\bwhat are\b|[A-Z]{2,6}-\d+"
    r"|error code\b|fault code\b|\bscreen\b|\bstatus\b|\bversion\b|\bidentifier\b)"
)
#: A term of keyword search.
TERM = r"[\p{L}0-9]+"
# English stop words of keyword search.
STOP_WORDS = "a an and are as at be but by for from has have he if in into is it its no not of on or s she such t that the their then there these they this to was were which will with".split()


def any_of(text: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(p)
    return found


def is_parser_noise(text: Column) -> Column:
    return any_of(text, PARSER_NOISE)


def is_chunk_noise(text: Column) -> Column:
    return any_of(text, CHUNK_NOISE)


def strip(text: Column) -> Column:
    """All white space at both ends, not only spaces."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))


def count_tokens(text: Column, floor: int = 1) -> Column:
    """Words times 1.33, cut to an integer; at least floor (1 for chunks, 0 for parents)."""
    n = F.floor(F.regexp_count(text, F.lit(r"\S+")) * F.lit(1.33)).cast("int")
    return F.greatest(F.lit(floor), n)


def clean(text: Column, preserve_ws: bool = False, nfkc: bool = False) -> Column:
    """Invisible characters removed, curly quotes straight, runs of blanks one, long runs of empty lines three."""
    out = F.translate(text, "\x00﻿​", "")
    if nfkc:
        out = F.when(out.rlike(r"[^\x00-\x7F]"), normalize_nfkc(out)).otherwise(out)
    out = F.translate(out, "‘’“”", "''\"\"")
    if not preserve_ws:
        out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"\n{4,}", "\n\n\n")
    return strip(F.regexp_replace(out, r"(?m)[ \t\f\r]+$", ""))


def normalize_nfkc(text: Column) -> Column:
    """Spark has no function for it; made when asked for, since executors import this module without a session."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return run(text)


def embed_text(prefix: Column, content: Column) -> Column:
    """What is embedded: the prefix, if there is any, above the content."""
    return F.when(F.coalesce(prefix, F.lit("")) == "", content).otherwise(F.concat(prefix, F.lit("\n\n"), content))


def leaf_text(prefix: Column, content: Column) -> Column:
    """What a summary tree reads: an empty prefix still adds its blank line."""
    return F.concat(F.coalesce(F.concat(prefix, F.lit("\n\n")), F.lit("")), content)


def entity_text(name: Column, description: Column) -> Column:
    return F.when(F.coalesce(description, F.lit("")) == "", name).otherwise(F.concat(name, F.lit(": "), description))


def heading_key(path: Column) -> Column:
    """First two headings that are not blank; [""] if there are none."""
    kept = F.slice(F.filter(F.transform(path, strip), lambda x: x != ""), 1, 2)
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(F.array(F.lit("")))


def heading_level(style: Column, levels: dict[str, int]) -> Column:
    """Level of a paragraph style: by name, else by its number, else 1."""
    named = F.element_at(F.create_map(*[F.lit(x) for kv in levels.items() for x in kv]), style) if levels else F.lit(None)
    number = F.regexp_extract(style, r"(?i)^Heading\s*(\d+)", 1)
    return F.coalesce(named, F.when(number != "", number.cast("int")), F.lit(1))


def entities(text: Column) -> Column:
    """Screen codes, equipment codes, procedure steps and field labels, sorted and distinct."""
    screens = F.transform(F.regexp_extract_all(text, F.lit(SCREEN_CODE), F.lit(1)), lambda x: F.concat(F.lit("Screen "), x))
    codes = F.regexp_extract_all(text, F.lit(EQUIPMENT_CODE), F.lit(0))
    steps = F.transform(F.regexp_extract_all(text, F.lit(PROCEDURE), F.lit(0)), F.initcap)
    labels = F.filter(F.transform(F.regexp_extract_all(text, F.lit(FIELD_LABEL), F.lit(1)), strip), lambda x: F.length(x) >= 3)
    return F.array_sort(F.array_distinct(F.concat(screens, codes, steps, labels)))


def needs_facts(query: Column) -> Column:
    return query.rlike(FACTUAL)


def simplified(query: Column, n: int = 5) -> Column:
    return F.array_join(F.slice(words(query), 1, n), " ")


def json_answer(text: Column) -> Column:
    """A model's JSON out of its code fence and without its thoughts; null if it is none."""
    inner = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)
    bare = F.when(text.contains("```"), inner).otherwise(text)
    bare = strip(F.regexp_replace(bare, r"(?s)<think>.*?</think>", ""))
    return F.when(F.try_parse_json(bare).isNotNull(), bare)


def community_title(summary: Column) -> Column:
    return F.substring(strip(F.substring_index(summary, ".", 1)), 1, 200)


def terms(text: Column, stop_words: list[str] | None = None) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))
    return F.array_except(found, F.array(*map(F.lit, stop_words))) if stop_words else found


def last_boundary(text: Column, max_pos: Column, share: float = 0.2, least: int = 50) -> Column:
    """Where a text is cut at max_pos characters or before: after the last sentence, paragraph, line or word end within the
    last fifth (50 characters at least) before max_pos, else at max_pos."""
    max_pos = F.least(max_pos, F.length(text))
    back = F.greatest(F.lit(least), (max_pos * F.lit(share)).cast("int"))
    start = F.greatest(F.lit(0), max_pos - back)
    window = F.substring(text, start + 1, max_pos - start)

    def after(mark: str, extra: int) -> Column:
        at = F.locate(mark[::-1], F.reverse(window))
        return F.when(at > 0, start + F.length(window) - at - len(mark) + 1 + extra)

    return F.coalesce(after(". ", 2), after(".\n", 2), after("\n\n", 2), after("\n", 1), after(" ", 1), max_pos)
