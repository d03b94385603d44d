"""Where in the corpus a name is defined: a table of definitions keyed by name, and requests that name no file."""

from __future__ import annotations

from collections.abc import Collection, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_newlines
from ..operators import config_files, dockerfile, python_symbols, script_symbols
from ..operators.references import words
from . import joins
from .lineage import stored

KINDS = ("python", "script", "json", "yaml", "dockerfile")
_DEFINED = "array<struct<name:string,any_case:boolean,level:int>>"


def _named(names: Column, level: int = 0, any_case: bool = False) -> Column:
    return F.transform(
        names, lambda n: F.struct(n.alias("name"), F.lit(any_case).alias("any_case"), F.lit(level).alias("level"))
    )


def _declared(files: DataFrame, kinds: Collection[str]) -> DataFrame:
    """``files`` with what ``defined_names`` reads. Each parser stops at names; those of kinds not asked for do not run."""
    kind, path, text = F.col("kind"), F.col("path"), normalize_newlines(F.col("text"))

    def of(*named: str) -> Column:
        return F.when(kind.isin(*named), text)

    config = [k for k in ("json", "yaml") if k in kinds]
    columns = {}
    if "python" in kinds:
        columns["symbols"] = python_symbols.defined_python(of("python"))
    if "script" in kinds:
        columns["statements"] = script_symbols.scanned_script(script_symbols.script_text(path, of("script")), outlines=True)
    if config:
        columns["config"] = config_files.parsed_config(of(*config), kind, False, F.array().cast("array<string>"))
    if "dockerfile" in kinds:
        columns["instr"] = dockerfile.instructions(of("dockerfile"))
    return files.withColumns(columns)


def defined_names(kinds: Collection[str] = KINDS) -> Column:
    """array<struct<name, any_case, level>> of a file read by ``_declared``: each name that ``symbol_body`` would answer.

    Python symbols have their nesting depth as level, build stages stand behind instruction types, which are met in any
    case and kept in lower case; all else is level 0.
    """
    def found() -> Iterator[tuple[Column, Column]]:
        kind, instr = F.col("kind"), F.col("instr")
        if "python" in kinds:
            yield kind == "python", F.transform(
                "symbols", lambda s: F.struct(s["name"].alias("name"), F.lit(False).alias("any_case"), s["depth"].alias("level"))
            )
        if "script" in kinds:
            yield kind == "script", _named(script_symbols.body_names(F.col("statements")))
        if "json" in kinds or "yaml" in kinds:
            yield kind.isin("json", "yaml"), _named(F.transform(F.col("config")["entries"], lambda e: e["key"]))
        if "dockerfile" in kinds:
            types = _named(F.array_distinct(F.transform(instr, lambda x: F.lower(x["inst"]))), 0, True)
            stages = _named(F.array_distinct(dockerfile.stage_names(instr)), 1)
            yield kind == "dockerfile", F.concat(types, stages)

    return F.coalesce(*[F.when(there, names.cast(_DEFINED)) for there, names in found()])


def definitions(files: DataFrame, kinds: Collection[str] = KINDS) -> DataFrame:
    """(name, any_case, level, path): one row for each name that a file of the chosen ``kinds`` defines."""
    chosen = files.where(F.col("kind").isin(*kinds)).select("path", "kind", "text")
    return _declared(chosen, kinds).select("path", F.inline(defined_names(kinds))).select("name", "any_case", "level", "path")


def _may_define(names: DataFrame) -> Column | None:
    """A filter on ``text`` for files that may define one of few plain names, so that the others are not parsed.

    A Python or script name stands in its file as a whole word; text beyond ASCII is let through, because Python
    identifiers are normalised when parsed. Keys and instructions may be written in other ways and are not filtered.
    """
    few = [r[0] for r in names.limit(joins.INLINE_NAMES + 1).collect()]
    if len(few) > joins.INLINE_NAMES or not all(n.isascii() and n.replace("_", "a").isalnum() for n in few):
        return None
    listed = F.array(*map(F.lit, few)) if few else F.array().cast("array<string>")
    written = F.arrays_overlap(words(F.col("text")), listed) | F.col("text").rlike(r"[^\x00-\x7F]")
    return ~F.col("kind").isin("python", "script") | written


def first_definitions(
    files: DataFrame, names: DataFrame, top: int = 1, kinds: Collection[str] = KINDS
) -> DataFrame:
    """(name, path, nth) for every ``names(name)`` that is defined: its first ``top`` files, outer levels first, then by path.

    Each task keeps its own first ``top`` of a name before anything is shuffled, so a name that every file defines costs
    as little as a rare one.
    """
    wanted = stored(names.select("name").where("name IS NOT NULL").distinct())
    chosen = _may_define(wanted)
    found = definitions(files if chosen is None else files.where(chosen), kinds)
    order = Window.partitionBy("name", "any_case").orderBy("level", "path")
    first = stored(found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top).drop("nth"))
    keys = wanted.select(
        F.col("name").alias("asked"),
        F.inline(F.array(
            F.struct(F.col("name").alias("name"), F.lit(False).alias("any_case")),
            F.struct(F.lower("name").alias("name"), F.lit(True).alias("any_case")),
        )),
    )
    met = keys.join(first, ["name", "any_case"]).groupBy(F.col("asked").alias("name"), "path").agg(F.min("level").alias("level"))
    nth = F.row_number().over(Window.partitionBy("name").orderBy("level", "path"))
    return met.withColumn("nth", nth).where(F.col("nth") <= top).select("name", "path", "nth")


def placed_requests(
    files: DataFrame, requests: DataFrame, top: int = 1, kinds: Collection[str] = KINDS
) -> tuple[DataFrame, DataFrame | None]:
    """``requests(req_id, path, name, …)`` with a path each, and those of null path whose name is defined nowhere.

    A null path stands for the whole corpus: the request comes back once for each of the first ``top`` files that define
    its name, with their paths. Requests for one name are salted, however many there are.
    """
    anywhere = requests.where("path IS NULL")
    if anywhere.isEmpty():
        return requests, None
    first = stored(first_definitions(files, anywhere, top, kinds).select("name", F.col("path").alias("_found")))
    asked = anywhere.select(F.struct(*requests.columns).alias("_request"), "name")
    found = joins.list_join(asked, first, ["name"]).select(
        *[F.col("_found").alias(c) if c == "path" else F.col("_request")[c].alias(c) for c in requests.columns]
    )
    nowhere = anywhere.join(first.select("name").distinct(), "name", "left_anti").select(requests.columns)
    named = requests.where("path IS NOT NULL")
    return stored(named.unionByName(found)), nowhere
