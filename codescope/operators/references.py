"""Where a name is used: whole-word line search for one name or a table of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NOT_WORD, WORD, word_pattern, word_pattern_column
from ..plans.joins import is_small, list_join, row_bytes
from .lines import file_lines


def find_references(files: DataFrame, symbol: str) -> DataFrame:
    """(symbol, path, line_no) for each line with ``symbol`` as a whole word; case-sensitive, one row per line.

    A narrow scan: a substring test on the whole text drops most files before any line is made.
    """
    candidates = files.where(F.contains("text", F.lit(symbol)))
    return (
        file_lines(candidates)
        .where(F.col("line").rlike(word_pattern(symbol)))
        .select(F.lit(symbol).alias("symbol"), "path", "line_no")
    )


def render_hits(refs: DataFrame) -> DataFrame:
    """Add ``hit`` as ``path:line``."""
    return refs.withColumn("hit", F.concat_ws(":", "path", "line_no"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{WORD}+"), F.lit(0))


# Two neighbouring words with what stands between them; matches overlap in their words.
_PAIR = rf"(?<!{WORD})(?=({WORD}++{NOT_WORD}++{WORD}++)){WORD}++"


def _pairs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_PAIR), F.lit(1))


def _longest(runs: Column) -> Column:
    return F.array_max(F.transform(runs, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]


def _anchor(symbol: Column) -> Column:
    """The run of characters by which a line holding ``symbol`` can be found with an equi-join.

    Every maximal word run inside a symbol is a whole word of a matching line, and its neighbours there are those in the
    line: so the longest two neighbours serve, and a single word if there are none. A symbol with no word character must
    sit between two word characters, so there it is a whole run of the others.
    """
    return F.coalesce(_longest(_pairs(symbol)), _longest(words(symbol)), symbol)


def find_references_bulk(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``find_references`` for every name in ``symbols(symbol)``, in one pass over the text.

    Each line gives its distinct words, which meet the names in an equi-join: broadcast when the names are few, else
    salted, because a common word may be a large part of all words. Names of two words and what stands between them meet
    the distinct neighbours of each line in the same way. All others are found by their longest neighbours, or their only
    word, and then checked: first for the text itself, then with the full pattern.
    """
    wanted = symbols.select("symbol").where(F.col("symbol").isNotNull()).distinct()
    plain = F.col("symbol").rlike(rf"^{WORD}+\z")
    pair = F.col("symbol").rlike(rf"^{WORD}++{NOT_WORD}++{WORD}++\z")
    several = F.col("symbol").rlike(f"{WORD}{NOT_WORD}++{WORD}")
    single = ~plain & ~several & F.col("symbol").rlike(WORD)
    shape = wanted.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(row_bytes(wanted)), F.lit(0)).alias("size"),
        F.bool_or(plain).alias("words"),
        F.bool_or(pair).alias("pairs"),
        F.bool_or(~pair & several).alias("phrases"),
        F.bool_or(single).alias("singles"),
        F.bool_or(~F.col("symbol").rlike(WORD) & (F.col("symbol") != "")).alias("signs"),
        F.bool_or(F.col("symbol") == "").alias("blank"),
    ).first()
    if shape.n == 0:
        return files.sparkSession.createDataFrame([], "symbol string, path string, line_no int")
    small = is_small(shape.n, shape.size)
    lines = file_lines(files)
    found = []

    for present, chosen, runs in ((shape.words, plain, words(F.col("line"))), (shape.pairs, pair, _pairs(F.col("line")))):
        if present:
            tokens = lines.select("path", "line_no", F.explode(F.array_distinct(runs)).alias("symbol"))
            found.append(list_join(tokens, wanted.where(chosen), ["symbol"], small, read_twice=False))
    for present, chosen, runs in (
        (shape.phrases, ~pair & several, _pairs(F.col("line"))),
        (shape.singles, single, words(F.col("line"))),
        (
            shape.signs,
            ~F.col("symbol").rlike(WORD) & (F.col("symbol") != ""),
            F.regexp_extract_all("line", F.lit(f"(?<={WORD}){NOT_WORD}+(?={WORD})"), F.lit(0)),
        ),
    ):
        if present:
            tokens = lines.select("path", "line_no", "line", F.explode(F.array_distinct(runs)).alias("anchor"))
            listed = wanted.where(chosen).select("symbol", _anchor(F.col("symbol")).alias("anchor"))
            joined = list_join(tokens, listed, ["anchor"], small, read_twice=False)
            met = F.when(F.contains("line", "symbol"), F.regexp_like("line", word_pattern_column(F.col("symbol"))))
            found.append(joined.where(met))
    if shape.blank:
        found.append(find_references(files, ""))

    hits = [f.select("symbol", "path", "line_no") for f in found]
    result = hits[0]
    for more in hits[1:]:
        result = result.unionByName(more)
    return result
