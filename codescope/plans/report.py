"""How much smaller each view of a file is than the file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..operators import config_files, dockerfile, python_views, script_symbols
from .views import problem, with_parsed

# Quantiles are told to a rank of one part in this many.
ACCURACY = 100_000
# A piece is a run of word characters or one other visible character: a tokenizer-free stand-in for tokens.
PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
# The same where all characters are ASCII, told by tables instead of Unicode properties.
ASCII_PIECE = r"\w++|[^\w\s]"


def _pieces(text: Column) -> Column:
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.regexp_count(text, F.lit(ASCII_PIECE))).otherwise(F.regexp_count(text, F.lit(PIECE))).cast("long")


def _size(view: str, text: Column) -> Column:
    return let(
        text,
        lambda t: F.struct(
            F.lit(view).alias("view"),
            F.lit(1).cast("long").alias("n_views"),
            F.length(t).cast("long").alias("chars"),
            _pieces(t).alias("pieces"),
        ),
    )


def _bodies(parsed: Column, text: Column) -> Column:
    """Every definition's body taken as a view of its own.

    No piece reaches over a line end, so pieces are counted once per line, and a body adds up its own lines.
    """
    zero = F.lit(0).cast("long")
    counts = F.transform(F.split(text, "\n"), _pieces)

    def pieces(lines: Column, s: Column) -> Column:
        own = F.slice(lines, s["start_line"], s["end_line"] - s["start_line"] + 1)
        return F.aggregate(own, zero, lambda acc, n: acc + n)

    def summed(lines: Column) -> Column:
        return F.struct(
            F.lit("symbol_body").alias("view"),
            F.size(parsed["symbols"]).cast("long").alias("n_views"),
            F.aggregate(parsed["symbols"], zero, lambda acc, s: acc + s["body_len"]).alias("chars"),
            F.aggregate(parsed["symbols"], zero, lambda acc, s: acc + pieces(lines, s)).alias("pieces"),
        )

    return let(counts, summed)


def _views(python: Column, statements: Column, config: Column, instr: Column) -> dict[str, Column]:
    """Text of every view of a parsed file."""
    kind, text = F.col("kind"), F.col("text")

    def pick(for_python: Column, for_script: Column, for_config: Column, for_docker: Column) -> Column:
        return (
            F.when(kind == "python", for_python)
            .when(kind == "script", for_script)
            .when(kind == "dockerfile", for_docker)
            .otherwise(for_config)
        )

    return {
        "file": text,
        "structure": pick(
            python_views.structure(python), script_symbols.structure(statements), config_files.structure(config),
            dockerfile.structure(instr),
        ),
        "skeleton": pick(
            python_views.skeleton(python), script_symbols.skeleton(statements), config_files.skeleton(config),
            dockerfile.skeleton(instr),
        ),
        "imports": pick(
            python_views.imports_block(python), script_symbols.imports_block(statements, F.col("script")),
            F.when(kind == "json", config_files.json_imports(text)).otherwise(config_files.yaml_imports(text)),
            dockerfile.base_images(instr),
        ),
    }


def _sized(files: DataFrame, sizes) -> DataFrame:
    """(path, kind, whole, …): the structs that ``sizes(views, parsed column, text)`` makes of each parseable file."""
    parsed = with_parsed(files, signatures=True)
    text, python = F.col("text"), F.col("parsed")
    made = sizes(_views(python, F.col("statements"), F.col("config"), F.col("instr")), python, text)
    return (
        parsed.withColumn("_problem", problem(parsed))
        .where(F.col("_problem").isNull())
        .select("path", "kind", F.length(text).cast("long").alias("whole"), F.inline(made))
    )


def view_sizes(files: DataFrame) -> DataFrame:
    """(path, kind, view, n_views, chars, pieces, file_chars): size of every view of every parseable file.

    ``file_chars`` is what reading the whole file for each view would cost.
    """
    def sizes(views: dict[str, Column], python: Column, text: Column) -> Column:
        bodies = F.when(F.col("kind") == "python", _bodies(python, text))
        return F.array_compact(F.array(*[_size(name, view) for name, view in views.items()], bodies))

    return _sized(files, sizes).select(
        "path", "kind", "view", "n_views", "chars", "pieces", (F.col("whole") * F.col("n_views")).alias("file_chars")
    )


def view_size_distribution(
    files: DataFrame, shares: Sequence[float] = (0.5, 0.9, 0.99), accuracy: int = ACCURACY
) -> DataFrame:
    """(kind, view, n_views, p50, p90, p99, most): quantiles of the characters of single views, bodies one by one.

    Per kind and view, with subtotals per view under a null ``kind``. Quantiles come from sketches that tasks merge, so
    only these are shuffled; each is a size that occurs, its rank off by at most a part in ``accuracy`` of the views.
    """
    def sizes(views: dict[str, Column], python: Column, text: Column) -> Column:
        def one(view: str, chars: Column) -> Column:
            return F.struct(F.lit(view).alias("view"), chars.cast("long").alias("chars"))

        bodies = F.transform(python["symbols"], lambda s: one("symbol_body", s["body_len"]))
        return F.concat(
            F.array(*[one(name, F.length(view)) for name, view in views.items()]),
            F.coalesce(bodies, F.array().cast("array<struct<view:string,chars:bigint>>")),
        )

    cuts = F.percentile_approx("chars", list(shares), accuracy)
    rolled = _sized(files, sizes).rollup("view", "kind").agg(
        F.count("*").alias("n_views"), cuts.alias("cuts"), F.max("chars").alias("most")
    ).where(F.col("view").isNotNull())
    named = [F.col("cuts")[i].alias(f"p{round(share * 100)}") for i, share in enumerate(shares)]
    return rolled.select("kind", "view", "n_views", *named, "most")


def view_cost_report(files: DataFrame) -> DataFrame:
    """(kind, view, n_views, chars, pieces, file_chars, saved): totals per kind and view, with subtotals per view.

    ``saved`` is the part of the characters that the view spares. A null ``kind`` is the total over all kinds. The
    aggregate has a handful of groups and is combined before its shuffle.
    """
    totals = [F.sum(c).alias(c) for c in ("n_views", "chars", "pieces", "file_chars")]
    sums = view_sizes(files).rollup("view", "kind").agg(*totals).where(F.col("view").isNotNull())
    saved = F.round(1 - F.try_divide(F.col("chars"), F.col("file_chars")), 6)
    return sums.select("kind", "view", "n_views", "chars", "pieces", "file_chars", saved.alias("saved"))
