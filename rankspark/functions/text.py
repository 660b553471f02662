"""Column functions over text: tokens, query terms, snippets, highlights, small helpers.

All of these are expressions, so they run inside the scan stage: no shuffle, no Python.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a name inside one expression.

    A value that a lambda reads from outside is evaluated again for every array element;
    bound through a one-element array it is evaluated once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_array(words: Sequence[str]) -> Column:
    """Literal ``array<string>``; typed also when empty."""
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def nonblank(value: Column) -> Column:
    """NULL for '' - the engine treats empty text and missing text alike."""
    return F.when(value != "", value)


def nonempty(array: Column) -> Column:
    """NULL for an empty array."""
    return F.when(F.size(array) > 0, array)


def find_all(text: Column, pattern: str) -> Column:
    """All matches of a pattern. Much faster than splitting at everything else."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def words_of(text: Column) -> Column:
    """White-space separated words."""
    return find_all(F.coalesce(text, F.lit("")), r"\S+")


def trim_space(value: Column) -> Column:
    """Trim every kind of white space, line breaks included."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def quote_phrase(phrase: Column) -> Column:
    """A regex that matches ``phrase`` literally, with any white space where it has a blank."""
    quoted = F.concat(F.lit(r"\Q"), phrase, F.lit(r"\E"))
    return F.replace(quoted, F.lit(" "), F.lit(r"\E\s+\Q"))


def tokenize(text: Column) -> Column:
    """Lower-cased tokens in text order; keeps c++, c#, ci/cd, node.js together."""
    return find_all(F.lower(F.coalesce(text, F.lit(""))), fixed.TOKEN_PATTERN)


def query_terms(
    text: Column,
    limit: int = fixed.MAX_QUERY_TERMS,
    stop_words: Sequence[str] = fixed.STOP_WORDS,
    min_chars: int = fixed.MIN_QUERY_TERM_CHARS,
) -> Column:
    """First ``limit`` distinct tokens that are long enough and not stop words."""
    long_enough = F.filter(tokenize(text), lambda t: F.length(t) >= min_chars)
    return F.slice(F.array_except(long_enough, words_array(stop_words)), 1, limit)


def snippet(text: Column, terms: Column) -> Column:
    """Words around the first word that contains the first matching term, else the first words."""

    def cut(words: Column) -> Column:
        bare = F.transform(words, lambda w: F.btrim(F.lower(w), F.lit(".,;:()")))

        def around(low: Column) -> Column:
            first = F.transform(
                terms,
                lambda t: F.array_position(
                    F.transform(low, lambda w: F.contains(w, t)), F.lit(True)
                ),
            )
            at = F.get(F.filter(first, lambda p: p > 0), F.lit(0)).cast("int")
            return let(
                at,
                lambda p: F.when(
                    p.isNull(), F.array_join(F.slice(words, 1, fixed.SNIPPET_HEAD), " ")
                ).otherwise(
                    let(
                        F.greatest(F.lit(1), p - fixed.SNIPPET_BEFORE),
                        lambda b: F.concat(
                            F.lit("…"),
                            F.array_join(
                                F.slice(words, b, p - 1 + fixed.SNIPPET_AFTER - b + 1), " "
                            ),
                            F.lit("…"),
                        ),
                    )
                ),
            )

        return let(bare, around)

    return let(words_of(text), cut)


def headline_fragment(text: Column, terms: Column) -> Column:
    """One fragment of the first 4000 characters with matched words in brackets.

    8 to 26 words, starting a few words before the first match.
    """

    def cut(words: Column) -> Column:
        hit = F.transform(
            words, lambda w: F.size(F.array_intersect(tokenize(w), terms)) > 0
        )
        marked = let(
            hit,
            lambda h: F.transform(
                words,
                lambda w, i: F.when(F.get(h, i), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w),
            ),
        )
        start = F.greatest(F.lit(1), F.array_position(hit, F.lit(True)).cast("int") - 4)
        return F.array_join(
            F.slice(marked, F.least(start, F.greatest(F.lit(1), F.size(words) - 7)), 26), " "
        )

    return let(words_of(F.substring(text, 1, 4000)), cut)


def highlight(text: Column, terms: Column) -> Column:
    """Wrap whole-token matches of ``terms`` in « » (case-insensitive)."""
    either = F.array_join(
        F.transform(terms, lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))), "|"
    )
    pattern = F.concat(F.lit("(?i)(?<![a-z0-9])("), either, F.lit(")(?![a-z0-9])"))
    return F.when(F.size(terms) > 0, F.regexp_replace(text, pattern, F.lit("«$1»"))).otherwise(
        text
    )


def round_half(value: Column, digits: int) -> Column:
    """Rounded half up at ``digits`` decimals, where a value that arithmetic has put a hair below a half counts as one.

    ``round`` reads 0.41874999999999996, which is 1 - 9.3 / 16, digit by digit and gives 0.4187.
    """
    unit = F.lit(float(10**digits))
    return F.round(value * unit) / unit


def fmt_number(value: Column) -> Column:
    """A number with six significant digits and no trailing zeros: 5, 7.5, 1863.84; -0, inf and nan as C prints them."""
    size = F.abs(value)
    rounded = F.round(value, 0)
    for limit, digits in ((100000, 1), (10000, 2), (1000, 3), (100, 4), (10, 5), (1, 6)):
        rounded = F.when(size < limit, F.round(value, digits)).otherwise(rounded)
    text = F.format_string("%.6f", rounded)
    plain = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    return (
        F.when(F.isnan(value), "nan").when(value == math.inf, "inf").when(value == -math.inf, "-inf")
        .when((value == 0) & F.startswith(value.cast("string"), F.lit("-")), "-0").otherwise(plain)
    )


def remove_phrases(text: Column, phrases: Column, bounded: bool = True) -> Column:
    """Replace each phrase by a blank. ``bounded`` spares matches inside longer words."""
    before, after = ("(?<![a-z0-9])", "(?![a-z0-9])") if bounded else ("", "")
    return F.aggregate(
        phrases,
        text,
        lambda acc, p: F.regexp_replace(
            acc, F.concat(F.lit("(?i)" + before), quote_phrase(p), F.lit(after)), F.lit(" ")
        ),
    )


def parse_years(text: Column, patterns: Sequence[str] = fixed.YEARS_PATTERNS) -> Column:
    """Minimum years: the first pattern that matches, its first number."""
    found = [nonblank(F.regexp_extract(text, p, 1)) for p in patterns]
    return F.coalesce(*found).cast("double")


def parse_years_range(text: Column) -> tuple[Column, Column]:
    """``a-b years`` as (low, high), both NULL when the text has no such range."""
    low, high = (
        nonblank(F.regexp_extract(text, fixed.YEARS_RANGE_PATTERN, g)).cast("double")
        for g in (1, 2)
    )
    return low, high


def is_remote(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(fixed.REMOTE_PATTERN)), F.lit(False))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def job_query_text(text: Column, skills: Column, city: Column, max_chars: int = 400) -> Column:
    """Search text for a job: skills, city, then the long words of its first 500 characters."""
    head = F.regexp_replace(F.substring(text, 1, 500), "\n", " ")
    long_words = F.filter(words_of(head), lambda w: F.length(w) > 6)
    bare = F.transform(long_words, lambda w: F.lower(F.btrim(w, F.lit(".,;:()"))))
    parts = F.concat(skills, F.array_compact(F.array(nonblank(city))), bare)
    return F.substring(F.array_join(F.array_distinct(parts), " "), 1, max_chars)
