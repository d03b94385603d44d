"""The texts a lookup answers with when there is nothing to show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .routing import SUPPORTED_TEXT, suffix

NO_SYMBOLS = "(no symbols found)"
NO_IMPORTS = "(no imports)"
NO_REFERENCES = "(no references found)"
EMPTY_OBJECT = "(empty object)"
NO_JSON_REFS = "(no $ref imports)"
NO_ANCHORS = "(no anchors or includes)"
EMPTY = "(empty)"
NO_FROM = "(no FROM instructions)"


def file_not_found(path: Column) -> Column:
    return F.concat(F.lit("File not found: "), path)


def symbol_not_found(name: Column, path: Column) -> Column:
    return F.concat(F.lit("Symbol '"), name, F.lit("' not found in "), path)


def unsupported(path: Column) -> Column:
    return F.concat(
        F.lit("Unsupported extension '"), suffix(path), F.lit("' in "), path, F.lit(f". Supported: {SUPPORTED_TEXT}")
    )


def parse_error(path: Column, detail: Column) -> Column:
    return F.concat(F.lit("Parse error in "), path, F.lit(": "), detail)
