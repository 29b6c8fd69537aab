"""Text normalisation, tokens and page statistics as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docketry.functions import fixed

#: White space as Python has it: Unicode's, and the four separators of files, groups, records and units.
SPACE = r"(?U)[\s\x1c-\x1f]"


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Composed form. Spark has no function for it: all texts pass through Python in Arrow batches, which is
    quick where they are composed already. Callers whose texts surely are say compose=False."""
    return _nfc(text)


def unify_punctuation(text: Column) -> Column:
    """Quotes, brackets and middle dots to one form each."""
    source = fixed.QUOTES_FROM + fixed.BRACKETS_FROM + fixed.MIDDOTS
    return F.translate(text, source, fixed.QUOTES_TO + fixed.BRACKETS_TO + "·" * len(fixed.MIDDOTS))


def drop_leaders(text: Column) -> Column:
    """A run of three middle dots or more, with white space around, becomes one space."""
    dots = fixed.MIDDOTS
    return F.regexp_replace(text, f"(?U)[{dots}\\s]*[{dots}]{{3,}}[{dots}\\s]*", " ")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def strip_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", "")


def normalize(text: Column, no_leader: bool = False, compose: bool = True) -> Column:
    out = unify_punctuation(nfc(text) if compose else text)
    return collapse(drop_leaders(out) if no_leader else out)


def normalize_field(value: Column, compose: bool = True) -> Column:
    """For comparing fields: no punctuation, no white space."""
    return strip_spaces(F.regexp_replace(nfc(value) if compose else value, fixed.FIELD_PUNCTUATION, ""))


def normalize_token(value: Column, compose: bool = True) -> Column:
    """For comparing titles and names."""
    return F.regexp_replace(nfc(value) if compose else value, fixed.TOKEN_PUNCTUATION, "")


def flat(text: Column) -> Column:
    """No white space, no commas."""
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f,]", "")


def words(text: Column) -> Column:
    return F.filter(F.split(collapse(text), " "), lambda w: w != "")


def tokenize(text: Column) -> Column:
    """White-space words, then character bigrams of the text without spaces; repeats stay."""
    # characters are split once; a substring by place would read the text from its start each time
    pairs = lambda cs: F.zip_with(F.slice(cs, 1, F.size(cs) - 1), F.slice(cs, 2, F.size(cs)), lambda a, b: F.concat(a, b))
    split = F.transform(F.array(F.filter(F.split(strip_spaces(text), ""), lambda c: c != "")), lambda cs: F.when(F.size(cs) >= 2, pairs(cs)).otherwise(F.array().cast("array<string>")))
    return F.concat(words(text), F.element_at(split, 1))


def title_words(title: Column, pattern: str = "[가-힣]{2,}", stop: tuple[str, ...] = fixed.RETRIEVAL_STOP) -> Column:
    """Content words of a title; repeats stay."""
    return F.filter(F.regexp_extract_all(title, F.lit(f"({pattern})")), lambda w: ~w.isin(*stop) if stop else F.lit(True))


def person_like(text: Column) -> Column:
    """Words of two to four syllables before or after a form of address."""
    after = F.regexp_extract_all(text, F.lit(f"{fixed.HONORIFICS}[\\s(（]*([가-힣]{{2,4}})"))
    before = F.regexp_extract_all(text, F.lit(f"([가-힣]{{2,4}})[\\s)）]*{fixed.HONORIFICS}"))
    return F.filter(F.array_union(after, before), lambda w: ~w.rlike(f"^{fixed.HONORIFICS}$") & ~w.isin(*fixed.LAYER_STOP))


def topic_words(text: Column, pattern: str = "[가-힣A-Za-z0-9]{2,}", stop: tuple[str, ...] = fixed.LAYER_STOP) -> Column:
    """Distinct words of a title that may tell its topic: no stop words, digits or likely persons."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})")))
    return F.array_except(F.filter(found, lambda w: ~w.isin(*stop) & ~w.rlike(r"\d")), person_like(text))


def sections(text: Column, labels: tuple[str, ...] = fixed.TABLE_LABELS, letter: str = "[가-힣]") -> Column:
    """Numbered headings, of 30 characters at most, with two letters or more, that don't start like a date and hold no table label."""
    found = F.transform(F.regexp_extract_all(text, F.lit(fixed.SECTION), F.lit(2)), lambda h: F.regexp_replace(h, r"(?U)^\s+|\s+$", ""))
    return F.filter(found, lambda h: (F.regexp_count(h, F.lit(letter)) >= 2) & ~h.rlike(fixed.DATE_LIKE) & ~has_any(h, labels))


def leader_ratio(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(f"([{fixed.LEADER_CHARS}]{{3,}})"))
    n = F.aggregate(runs, F.lit(0), lambda a, r: a + F.length(r))
    return F.when(F.length(text) > 0, n / F.length(text)).otherwise(F.lit(0.0))


def lines(text: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def short_line_ratio(text: Column, limit: int = fixed.SHORT_LINE_CHARS) -> Column:
    """struct(ratio, lines)."""

    def of(found: Column) -> Column:
        ratio = F.when(F.size(found) > 0, F.size(F.filter(found, lambda x: F.length(x) < limit)) / F.size(found)).otherwise(F.lit(0.0))
        return F.struct(ratio.alias("ratio"), F.size(found).alias("lines"))

    return F.element_at(F.transform(F.array(lines(text)), of), 1)


def page_type(text: Column, gutter: Column | None = None) -> Column:
    """toc, table, body_2col or body_1col; the first that applies."""
    return page_stats(text, gutter)["page_type"]


def page_stats(text: Column, gutter: Column | None = None) -> Column:
    """struct(page_type, leader_ratio, short_line_ratio, lines); lines are split once."""

    def of(short: Column) -> Column:
        leaders = leader_ratio(text)
        kind = (
            F.when(leaders >= fixed.TOC_LEADER_RATIO, "toc")
            .when((short["lines"] >= fixed.TABLE_MIN_LINES) & (short["ratio"] >= fixed.TABLE_SHORT_RATIO), "table")
            .when(F.coalesce(gutter, F.lit(False)) if gutter is not None else F.lit(False), "body_2col")
            .otherwise("body_1col")
        )
        return F.struct(kind.alias("page_type"), leaders.alias("leader_ratio"), short["ratio"].alias("short_line_ratio"), short["lines"].alias("lines"))

    return F.element_at(F.transform(F.array(short_line_ratio(text)), of), 1)


def first_rule(text: Column, rules: tuple[tuple[str, tuple[str, ...]], ...], default: str, squeeze: bool = True) -> Column:
    """Key of the first rule one of whose words is in the text."""
    body, out = strip_spaces(text) if squeeze else text, None
    for key, keywords in rules:
        hit = F.lit(False)
        for w in keywords:
            hit = hit | body.contains(w)
        out = F.when(hit, key) if out is None else out.when(hit, key)
    return F.lit(default) if out is None else out.otherwise(default)


def doc_type(title: Column) -> Column:
    return first_rule(title, fixed.DOC_TYPES, fixed.DOC_TYPE_DEFAULT)


def work_type(title: Column) -> Column:
    return first_rule(title, fixed.WORK_TYPES, fixed.WORK_TYPE_DEFAULT)


def title_level(title: Column, levels=fixed.TITLE_LEVELS) -> Column:
    """Level by the ending of a title; earlier entries take precedence."""
    t, out = strip_spaces(title), None
    for endings, level in levels:
        hit = F.lit(False)
        for e in endings:
            hit = hit | t.endswith(e)
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out.otherwise(0)


def has_any(text: Column, keywords: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in keywords:
        out = out | text.contains(w)
    return out
