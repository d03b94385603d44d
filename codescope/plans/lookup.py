"""Batches of lookups: a table of requests in, one answer per request out. A miss is an answer, never an error."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import messages
from ..operators import config_files, dockerfile, python_views, script_symbols
from ..operators.references import find_references_bulk
from ..operators.resolved import resolved_references
from . import views
from .definitions import KINDS, placed_requests
from .joins import attach_requests, each_request, fits_broadcast, list_join, restrict_to_paths, with_requests
from .lineage import stored


def _asked(requests: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of the requests, and ``_request`` with all of them, whatever their names."""
    return requests.select("req_id", "path", *columns, F.struct(*requests.columns).alias("_request"))


def _missing(requests: DataFrame, kind: T.DataType) -> DataFrame:
    """The answers to ``requests`` whose file is not there."""
    return requests.select(
        *requests.columns, F.lit("not_found").alias("status"),
        messages.file_not_found(F.coalesce("path", F.lit(""))).alias("message"), F.lit(None).cast(kind).alias("result"),
    )


def _answers(files: DataFrame, requests: DataFrame, found: DataFrame, small: bool) -> DataFrame:
    """``found(_request, status, message, result)`` spread out, and the requests whose file is not there.

    What is missing is told by paths alone, so no answer is shuffled for it.
    """
    existing = restrict_to_paths(files.select("path"), requests, small).distinct()
    missing = requests.join(F.broadcast(existing) if small else existing, "path", "left_anti")
    answered = found.select("_request.*", "status", "message", "result")
    return answered.unionByName(_missing(missing, found.schema["result"].dataType))


def _answers_met(requests: DataFrame, found: DataFrame) -> DataFrame:
    """As ``_answers`` where ``found`` has every request with a path, its ``_there`` null without a file: the join that
    brought the requests to the texts has told them, so the corpus is not read again."""
    there = F.col("_there").isNotNull()
    answered = found.select(
        "_request.*", F.when(there, F.col("status")).otherwise("not_found").alias("status"),
        F.when(there, F.col("message")).otherwise(messages.file_not_found(F.col("_request.path"))).alias("message"),
        F.when(there, F.col("result")).alias("result"),
    )
    return answered.unionByName(_missing(requests.where("path IS NULL"), found.schema["result"].dataType))


def _per_symbol(
    files: DataFrame,
    requests: DataFrame,
    result: Column,
    missing: Column,
    top: int = 1,
    kinds: Collection[str] = KINDS,
    **parse: bool,
) -> DataFrame:
    """Answer ``requests(req_id, path, name)`` by a row-local expression on the parsed file they name.

    Only the named files are parsed. The requests come to the files, not the other way round, while they are few. A
    request without a path is answered from the first ``top`` files of the whole corpus that define its name.
    """
    requests, nowhere = placed_requests(files, requests, top, kinds)
    if nowhere is not None:
        found = _per_symbol(files, requests, result, missing, **parse)
        unknown = messages.symbol_not_found(F.coalesce("name", F.lit("")), F.lit("the corpus"))
        return found.unionByName(
            nowhere.select(
                "*", F.lit("symbol_not_found").alias("status"), unknown.alias("message"),
                F.lit(None).cast(found.schema["result"].dataType).alias("result"),
            )
        )
    small = fits_broadcast(requests)
    needed = files.select("path", "kind", "text", *[c for c in files.columns if c == "status"])
    asked = _asked(requests, "name").drop("req_id")
    together = None if small else with_requests(needed, asked, "left")
    if together is None:
        parsed = views.with_parsed(restrict_to_paths(needed, requests, small), **parse)
        met = attach_requests(parsed, _asked(requests, "name"), small)
    else:  # one join brings the requests to the texts, and what is parsed of these is never shuffled
        met = each_request(views.with_parsed(together, names=F.col("_asked.name"), **parse))
    failed = met.withColumn("_problem", views.problem(met)).withColumn(
        "result", F.when(F.col("_problem").isNull(), result)
    )
    found = failed.select(
        "_request",
        F.when(F.col("_problem").isNotNull(), F.col("_problem.status"))
        .when(F.col("result").isNull(), "symbol_not_found")
        .otherwise("ok")
        .alias("status"),
        F.when(F.col("_problem").isNotNull(), F.col("_problem.message"))
        .when(F.col("result").isNull(), missing)
        .alias("message"),
        "result",
        *[c for c in met.columns if c == "_there"],
    )
    return _answers(files, requests, found, small) if together is None else _answers_met(requests, found)


def symbol_body(files: DataFrame, requests: DataFrame, top: int = 1) -> DataFrame:
    """Source of a class or function, value of a key, or instructions of a type or stage.

    Here and below a null ``path`` stands for the whole corpus: the answer comes from the file that defines the name,
    an outer definition before an inner one and then by path, and its path is given; ``top`` asks for more than one.
    """
    kind, name, path = F.col("kind"), F.col("name"), F.col("path")
    result = (
        F.when(kind == "python", python_views.symbol_body(F.col("parsed"), F.col("text"), name))
        .when(kind == "script", script_symbols.symbol_body(F.col("statements"), F.col("script"), name))
        .when(kind == "dockerfile", dockerfile.body(F.col("instr"), name))
        .otherwise(config_files.key_body(F.col("config"), name))
    )
    missing = (
        F.when(kind.isin("python", "script"), messages.symbol_not_found(name, path))
        .when(kind == "dockerfile", dockerfile.missing(F.col("instr"), name))
        .otherwise(config_files.missing(F.col("config"), kind, name))
    )
    return _per_symbol(files, requests, result, missing, top, bodies=True)


def symbol_card(files: DataFrame, requests: DataFrame, top: int = 1) -> DataFrame:
    """Signature and documentation of a symbol of a Python file; symbols of other files are not found."""
    card = python_views.symbol_card(F.col("parsed"), F.col("name"))
    missing = messages.symbol_not_found(F.col("name"), F.col("path"))
    return _per_symbol(files, requests, card, missing, top, ("python",), signatures=True, config=False)


def locate_definition(files: DataFrame, requests: DataFrame, top: int = 1) -> DataFrame:
    """(…, line, col), from 0, of a symbol's name in its Python file; null where there is none."""
    place = python_views.location(F.col("parsed"), F.col("name"))
    missing = messages.symbol_not_found(F.col("name"), F.col("path"))
    answered = _per_symbol(files, requests, place, missing, top, ("python",), config=False)
    return answered.select("*", "result.line", "result.col").drop("result")


def find_references(files: DataFrame, requests: DataFrame) -> DataFrame:
    """(req_id, name, path, line_no, status, message) for ``requests(req_id, name)`` over the whole corpus.

    One row per hit; a request with none keeps one row that says so.
    """
    hits = stored(
        find_references_bulk(files, requests.select(F.col("name").alias("symbol"))).withColumnRenamed("symbol", "name")
    )
    asked = requests.select("req_id", "name")
    found = list_join(hits, asked, ["name"])
    silent = asked.join(hits.select("name").distinct(), "name", "left_anti")
    return found.select(
        "req_id", "name", "path", "line_no", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("message")
    ).unionByName(
        silent.select(
            "req_id", "name", F.lit("no_references").alias("status"), F.lit(messages.NO_REFERENCES).alias("message")
        ),
        allowMissingColumns=True,
    )


_FILE_VIEWS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "structure": views.structure,
    "skeleton": views.skeleton,
    "imports": views.imports,
}
_SYMBOL_VIEWS = {"symbol_body": symbol_body, "symbol_card": symbol_card, "locate": locate_definition}


def _reference_rows(hits: DataFrame, requests: DataFrame) -> DataFrame:
    shown = F.when(F.col("hit_path").isNotNull(), F.concat_ws(":", "hit_path", "line_no"))
    return hits.join(requests, "req_id").select(*requests.columns, "status", "message", shown.alias("result"))


def references(files: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per hit of ``requests(req_id, path, name)`` over the whole corpus, ``result`` being ``path:line``."""
    return _reference_rows(find_references(files, requests).withColumnRenamed("path", "hit_path").drop("name"), requests)


def resolved(files: DataFrame, requests: DataFrame) -> DataFrame:
    """As ``references``, for the symbol that ``path`` defines under that name, or the corpus where that is null."""
    requests, nowhere = placed_requests(files, requests, kinds=("python",))
    requests = requests if nowhere is None else stored(requests.unionByName(nowhere))
    asked = requests.select("req_id", F.col("name").alias("symbol"), "path")
    hits = resolved_references(files, asked).withColumnRenamed("path", "hit_path").drop("symbol")
    return _reference_rows(hits, requests)


_REFERENCE_VIEWS = {"references": references, "resolved_references": resolved}


def batch_lookup(files: DataFrame, requests: DataFrame, view: str, **options: bool | int) -> DataFrame:
    """Any view for ``requests(req_id, path[, name])`` with ``status``, ``message`` and ``result``.

    One row per request; reference views have one per hit. ``options`` go to the view: ``labels`` to ``structure``,
    ``as_written`` to ``skeleton``, ``top`` to those of one symbol. A null path stands for the whole corpus wherever the
    request has a name; a view of one file needs its path.
    """
    if view in _SYMBOL_VIEWS or view in _REFERENCE_VIEWS:
        return (_SYMBOL_VIEWS | _REFERENCE_VIEWS)[view](files, requests, **options)
    small = fits_broadcast(requests)
    needed = files.select("path", "kind", "text", *[c for c in files.columns if c == "status"])
    together = None if small else with_requests(needed, _asked(requests).drop("req_id"), "left")
    if together is None:
        shown = _FILE_VIEWS[view](restrict_to_paths(files, requests, small), **options)
        met = attach_requests(shown, _asked(requests), small)
    else:
        met = each_request(_FILE_VIEWS[view](together, **options))
    ok = F.col("status") == "ok"
    found = met.select(
        "_request", "status", F.when(~ok, F.col("view")).alias("message"), F.when(ok, F.col("view")).alias("result"),
        *[c for c in met.columns if c == "_there"],
    )
    return _answers(files, requests, found, small) if together is None else _answers_met(requests, found)
