"""Column helpers for source text: newline rules, line arrays, word boundaries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word character in the Unicode sense (letters, numbers, underscore). Java's \w is ASCII only.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it freely inside ``body``.

    Catalyst inlines a projected column into a lambda that mentions it, so ``split(text)`` used as an outer column
    of a lambda would be re-split for every element. Binding it as a lambda variable keeps it single-evaluation.
    """
    return F.transform(F.array(value), body)[0]


def normalize_newlines(text: Column) -> Column:
    """``\\r\\n`` and lone ``\\r`` become ``\\n``; text without ``\\r`` is passed through untouched."""
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def split_lines(text: Column) -> Column:
    """Lines as an array; a final newline does not open another line."""
    return let(
        F.split(normalize_newlines(text), "\n"),
        lambda pieces: F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(
            pieces
        ),
    )


# The characters that Python's ``str.strip`` and ``str.split`` take as white space.
SPACES = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
              0x202F, 0x205F, 0x3000]
)
NOT_SPACE_RUN = r"[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def strip(text: Column) -> Column:
    """Remove Unicode white space from both ends."""
    return F.btrim(text, F.lit(SPACES))


def join_or(lines: Column, empty: str) -> Column:
    """Newline-joined array, or ``empty`` when there is nothing to join."""
    return let(lines, lambda x: F.when(F.size(x) == 0, F.lit(empty)).otherwise(F.array_join(x, "\n")))


# Labels of symbol kinds. Kinds without a label print without one.
KIND_LABELS = {
    "class": "Class",
    "method": "Method",
    "constructor": "Constructor",
    "interface": "Interface",
    "function": "Function",
}


def label(kind: Column) -> Column:
    """``[Class] `` and so on in front of a name, empty for other kinds."""
    named = F.coalesce(*[F.when(kind == k, F.lit(f"[{text}] ")) for k, text in KIND_LABELS.items()])
    return F.coalesce(named, F.lit(""))


def quote_regex(symbol: str) -> str:
    return r"\Q" + symbol.replace(r"\E", r"\E\\E\Q") + r"\E"


def word_pattern(symbol: str) -> str:
    """Java regex for ``symbol`` as a whole word.

    At an end that is a word character no word character may follow outside; at an end that is not one, a word
    character must stand outside. The empty symbol matches wherever there is any word character.
    """
    if not symbol:
        return WORD
    left = rf"(?<!{WORD})" if re.match(r"\w", symbol) else rf"(?<={WORD})"
    right = rf"(?!{WORD})" if re.search(r"\w\Z", symbol) else rf"(?={WORD})"
    return left + quote_regex(symbol) + right


def word_pattern_column(symbol: Column) -> Column:
    """``word_pattern`` for a column of non-empty symbols."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(symbol, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    left = F.when(symbol.rlike(rf"^{WORD}"), F.lit(rf"(?<!{WORD})")).otherwise(F.lit(rf"(?<={WORD})"))
    right = F.when(symbol.rlike(rf"{WORD}\z"), F.lit(rf"(?!{WORD})")).otherwise(F.lit(rf"(?={WORD})"))
    return F.concat(left, quoted, right)
