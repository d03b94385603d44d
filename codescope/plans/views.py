"""The same question asked of every file of a mixed corpus: listing, skeleton, imports.

All kinds are answered in one pass over the files. Each parser sees only the text of its own kind (the others give it
null), all of them in one Python stage, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import messages
from ..functions.text import normalize_newlines
from ..operators import config_files, dockerfile, python_symbols, python_views, script_symbols

_CONFIG = ("json", "yaml")


def with_parsed(
    files: DataFrame, signatures: bool = False, bodies: bool = False, config: bool = True, names: Column | None = None
) -> DataFrame:
    """Add ``parsed`` (Python), ``script`` and ``statements`` (scripts), ``config`` (JSON, YAML), ``instr`` (Docker).

    ``text`` comes out with ``\\n`` line ends. Each column is null in rows of other kinds. With ``names``, an array in each
    row, only what lookups of these names read is worked out; Dockerfiles are cut as ever.
    """
    kind, path = F.col("kind"), F.col("path")
    prepared = files.withColumn("text", normalize_newlines(F.col("text"))).withColumn(
        "script", F.when(kind == "script", script_symbols.script_text(path, F.col("text")))
    )
    columns = {
        "parsed": python_symbols.parsed_python(F.when(kind == "python", F.col("text")), signatures, names=names),
        "statements": script_symbols.scanned_script(F.col("script"), names),
    }
    if config:
        columns["config"] = config_files.parsed_config(F.when(kind.isin(*_CONFIG), F.col("text")), kind, bodies, names)
    columns["instr"] = dockerfile.instructions(F.when(kind == "dockerfile", F.col("text")))
    return prepared.withColumns(columns)


def problem(parsed: DataFrame) -> Column:
    """struct<status, message> of a file that has no views, else null."""
    kind, path = F.col("kind"), F.col("path")

    def because(status: str, message: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), message.alias("message"))

    no_text = F.col("text").isNull()
    readable = F.col("status") if "status" in parsed.columns else F.lit("ok")
    found = (
        F.when(kind.isNull(), because("unsupported", messages.unsupported(path)))
        .when(
            no_text & (readable == "decode_error"),
            because("parse_error", messages.parse_error(path, F.lit("not valid UTF-8"))),
        )
        .when(no_text, because("not_found", messages.file_not_found(path)))
        .when(
            F.col("parsed.error").isNotNull(),
            because("parse_error", messages.parse_error(path, F.col("parsed.error"))),
        )
    )
    if "config" in parsed.columns:
        found = found.when(
            F.col("config.error").isNotNull(),
            because("parse_error", config_files.parse_failure(path, kind, F.col("config"))),
        )
    return found


def _by_kind(python: Column, script: Column, config: dict[str, Column], docker: Column) -> Column:
    kind = F.col("kind")
    chosen = F.when(kind == "python", python).when(kind == "script", script).when(kind == "dockerfile", docker)
    for name, column in config.items():
        chosen = chosen.when(kind == name, column)
    return chosen


def _of_kinds(files: DataFrame, kinds: Collection[str] | None) -> DataFrame:
    """Files of the named kinds; the filter stands below the parsers, so the scan reads and they parse no others."""
    return files if kinds is None else files.where(F.col("kind").isin(*kinds))


def _view(parsed: DataFrame, view: Column) -> DataFrame:
    """The view of each file, with ``_asked`` and ``_there``, the requests to it, where they came along."""
    failed = parsed.withColumn("_problem", problem(parsed))
    return failed.select(
        "path",
        "kind",
        F.coalesce("_problem.status", F.lit("ok")).alias("status"),
        F.when(F.col("_problem").isNotNull(), F.col("_problem.message")).otherwise(view).alias("view"),
        *[c for c in parsed.columns if c in ("_asked", "_there")],
    )


def structure(files: DataFrame, labels: bool = False, kinds: Collection[str] | None = None) -> DataFrame:
    """(path, kind, status, view): names only. ``labels`` puts the kind in front of Python and script symbols."""
    config = config_files.structure(F.col("config"))
    return _view(
        with_parsed(_of_kinds(files, kinds)),
        _by_kind(
            python_views.structure(F.col("parsed"), labels),
            script_symbols.structure(F.col("statements"), labels),
            dict.fromkeys(_CONFIG, config),
            dockerfile.structure(F.col("instr")),
        ),
    )


def skeleton(files: DataFrame, as_written: bool = False, kinds: Collection[str] | None = None) -> DataFrame:
    """(path, kind, status, view): signatures and first doc lines. ``as_written`` shows raw lines of Python and scripts."""
    config = config_files.skeleton(F.col("config"))
    if as_written:
        python = python_views.line_skeleton(F.col("parsed"))
        script = script_symbols.line_skeleton(F.col("statements"), F.col("script"))
    else:
        python, script = python_views.skeleton(F.col("parsed")), script_symbols.skeleton(F.col("statements"))
    return _view(
        with_parsed(_of_kinds(files, kinds), signatures=True),
        _by_kind(
            python,
            script,
            dict.fromkeys(_CONFIG, config),
            dockerfile.skeleton(F.col("instr")),
        ),
    )


def imports(files: DataFrame, kinds: Collection[str] | None = None) -> DataFrame:
    """(path, kind, status, view): import blocks, ``$ref`` strings, anchors and includes, or base images."""
    return _view(
        with_parsed(_of_kinds(files, kinds), config=False),
        _by_kind(
            python_views.imports_block(F.col("parsed")),
            script_symbols.imports_block(F.col("statements"), F.col("script")),
            {"json": config_files.json_imports(F.col("text")), "yaml": config_files.yaml_imports(F.col("text"))},
            dockerfile.base_images(F.col("instr")),
        ),
    )
