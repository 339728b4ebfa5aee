"""Text folding, keys and small text predicates as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKS = "".join(map(chr, range(0x0300, 0x0370)))


def _latin_letters() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from the Unicode decompositions."""
    accented, plain = [], []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isascii() and all(unicodedata.combining(p) for p in parts[1:]):
            accented.append(chr(code))
            plain.append(parts[0])
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _latin_letters()
DASHES, QUOTES, TRADE_MARKS = "\u2010\u2011\u2012\u2013\u2014\u2015", "\u201c\u201d\u2018\u2019", "\u2122\u00ae"


def strip_accents(c: Column) -> Column:
    """Letters without their marks, for precomposed and for decomposed input; ASCII text, told by its size, stays as it is."""
    # Signs without a counterpart are dropped, so one pass does it all.
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(c, ACCENTED + MARKS, PLAIN))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeeze(c: Column) -> Column:
    # A single space stays as it is, so it is no match.
    return F.trim(F.regexp_replace(c, "(?U)\\s{2,}|[^\\S ]", " "))


def fold(c: Column) -> Column:
    """Lower case, no accents, single spaces."""
    return squeeze(F.lower(strip_accents(c)))


def fold_print(c: Column) -> Column:
    """``fold`` for printed text: dashes and quotes unified, trade marks dropped."""
    plain = F.translate(c, ACCENTED + DASHES + QUOTES + MARKS + TRADE_MARKS, PLAIN + "-" * len(DASHES) + '"' * len(QUOTES))
    return squeeze(F.lower(F.when(F.octet_length(c) == F.length(c), c).otherwise(plain)))


def part_key(c: Column) -> Column:
    """A part number as typed by anyone: upper case, letters and digits only."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "")


def code_key(c: Column) -> Column:
    """A type code without spaces and case."""
    return F.regexp_replace(F.lower(F.trim(c)), "(?U)\\s+", "")


def field_key(c: Column) -> Column:
    """A field name without case, underscores or separators."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def header_key(c: Column) -> Column:
    """A column heading reduced to plain words."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", " "))


def mode_token(c: Column) -> Column:
    """A mode name without its bracketed variant, in snake case."""
    base = F.trim(F.lower(F.split_part(c, F.lit("("), F.lit(1))))
    return F.regexp_replace(base, "[\\s-]+", "_")


def fold_words(c: Column) -> Column:
    """Letters and digits of any script, one space between words."""
    return F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", " "))


def number_text(c: Column, places: int = 6) -> Column:
    """A number without binary noise or trailing zeros."""
    fixed = F.round(c.cast("double"), places).cast(f"decimal(30,{places})").cast("string")
    return F.regexp_replace(fixed, "\\.?0+$", "")


def any_of(words: Sequence[str]) -> str:
    """A regex alternation of literal words, longest first."""
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def detect_language(c: Column, first: str, second: str, first_words: Sequence[str], second_words: Sequence[str],
                    first_letters: str) -> Column:
    """``first`` if its own letters occur, else the language whose function words are more frequent."""
    text = F.lower(c)
    # Word edges are ASCII here, so an accented letter ends a word in both languages alike.
    hits = [
        F.regexp_count(text, F.lit("(?<![a-z0-9_])(?:" + any_of(w) + ")(?![a-z0-9_])"))
        for w in (first_words, second_words)
    ]
    return (
        F.when(c.isNull(), F.lit(None))
        .when(text.rlike(f"[{first_letters}]"), first)
        .when(hits[0] >= hits[1], first)
        .otherwise(second)
    )


def problem_keywords(c: Column, stopwords: Sequence[str], min_length: int = 5, limit: int | None = None) -> Column:
    """Longer words of a description, stopwords left out, in order of appearance; the first ``limit`` if one is given."""
    words = F.split(F.lower(strip_accents(c)), "[^a-z0-9]+")
    kept = F.filter(words, lambda w: (F.length(w) >= min_length) & ~w.isin(*stopwords))
    return kept if limit is None else F.slice(kept, 1, limit)


# What a catalog order number and a type code look like in running text.
# Word edges are spelled out, as they must be ASCII ones: an accented letter does not continue a number.
START, END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
ORDER_NUMBER_IN_TEXT = f"{START}\\d{{7}}{END}"
TYPE_CODE_IN_TEXT = f"{START}[A-Z]{{2,4}}\\d{{1,3}}[A-Z]?-(?=[A-Z0-9]{{5,}}{END})(?=[A-Z0-9]*\\d)[A-Z0-9]{{5,}}{END}"


def contains_part_reference(c: Column) -> Column:
    return c.rlike(ORDER_NUMBER_IN_TEXT) | c.rlike(TYPE_CODE_IN_TEXT)


def redact_foreign_ids(c: Column, own: Column, mask: str = "[part number removed]") -> Column:
    """Hide every order number in a text but the row's own."""
    # The own number is shielded by a marker that cannot occur in text, then put back.
    shield = F.lit("\u0001")
    own_pattern = F.concat(F.lit(START), own, F.lit(END))
    shielded = F.regexp_replace(c, own_pattern, shield)
    masked = F.regexp_replace(F.coalesce(shielded, c), ORDER_NUMBER_IN_TEXT, mask)
    return F.when(own.isNull(), masked).otherwise(F.replace(masked, shield, own))


def gloss(c: Column, terms: dict[str, str], rules: Sequence[tuple[str, str]] = ()) -> Column:
    """Replace known phrases by their translation, longest match first; NULL when nothing changed.

    ``terms`` is a dictionary of folded phrases given by the caller; ``rules``
    are regex rewrites applied before the lookup.
    """
    phrases = any_of(list(terms))
    token = f"(?<![a-z0-9])(?:{phrases})(?![a-z0-9])|[a-z0-9]+|[^a-z0-9]"
    table = F.create_map(*[F.lit(x) for pair in terms.items() for x in pair])

    def replaced(start: Column) -> Column:
        staged = start
        for pattern, replacement in rules:
            staged = F.regexp_replace(staged, pattern, replacement)
        pieces = F.regexp_extract_all(staged, F.lit(token), F.lit(0))
        return squeeze(F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(table, p), p)), ""))

    return let(fold_print(c), lambda start: let(replaced(start), lambda out: F.when((start != "") & (out != start), out)))


def keywords(c: Column, triggers: Sequence[tuple[str, Sequence[str]]], limit: int = 14) -> Column:
    """Search words of every trigger that starts a word of the text, distinct without case, in trigger order."""
    nothing = F.array().cast("array<string>")

    def found(text: Column) -> Column:
        return F.flatten(
            F.array(
                *[
                    F.when(text.rlike("(?<![a-z0-9])" + re.escape(trigger)), F.array(*[F.lit(w) for w in words])).otherwise(nothing)
                    for trigger, words in triggers
                ]
            )
        )

    def distinct(words: Column) -> Column:
        # A word is kept where its lower-cased form occurs for the first time.
        lowered = F.transform(words, lambda w: F.lower(w))
        return F.filter(words, lambda w, i: F.array_position(lowered, F.lower(w)) == i + 1)

    return F.slice(let(let(fold_print(c), found), distinct), 1, limit)


def quoted_in(quote: Column, text: Column) -> Column:
    """Whether a quote occurs in a text once both are reduced to words."""
    needle = fold_words(quote)
    return F.coalesce((needle != "") & F.contains(fold_words(text), needle), F.lit(False))
