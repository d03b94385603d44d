"""Dockerfiles: instructions, stages and their views. Texts are cut into instructions by Arrow batches; the rest are
column expressions, local to a file's row."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import messages
from ..functions.batches import by_slices
from ..functions.text import join_or, let

# Fixed value: instructions shown in the skeleton.
SKELETON_INSTRUCTIONS = ["FROM", "CMD", "ENTRYPOINT", "EXPOSE", "ENV", "ARG", "WORKDIR", "USER"]
INSTRUCTIONS = "array<struct<line_no:int,inst:string,args:string>>"
_ARROW = pa.list_(pa.struct([("line_no", pa.int32()), ("inst", pa.string()), ("args", pa.string())]))


def _cut(texts: pa.Array) -> pa.Array:
    """The instructions of each text: lines that are not blank and no comments, cut behind their first word."""
    numbers, first, rest, ends = [], [], [], [0]
    for text in texts.to_pylist():
        if text is not None:
            for number, line in enumerate(text.splitlines(), start=1):
                parts = line.split(None, 1)
                if parts and not parts[0].startswith("#"):
                    numbers.append(number)
                    first.append(parts[0].upper())
                    rest.append(parts[1].rstrip() if len(parts) > 1 else "")
        ends.append(len(numbers))
    fields = {"line_no": pa.array(numbers, pa.int32()), "inst": pa.array(first, pa.string()), "args": pa.array(rest, pa.string())}
    rows = pa.StructArray.from_arrays(list(fields.values()), list(fields))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, mask=texts.is_null() if texts.null_count else None)


def _instructions(texts: pa.Array) -> pa.Array:
    return pa.nulls(len(texts), _ARROW) if texts.null_count == len(texts) else by_slices(_cut, texts)


_instructions.__annotations__ = {"texts": pa.Array, "return": pa.Array}


def instructions(text: Column, join_continuations: bool = False) -> Column:
    """array<struct<line_no, inst, args>>; null text gives null. Continued lines count as lines of their own unless joined."""
    if join_continuations:
        text = F.regexp_replace(text, r"\\[ \t]*\r?\n", " ")
    # As for the other parsers, filters on the result must not run it a second time.
    return F.arrow_udf(_instructions, INSTRUCTIONS).asNondeterministic()(text)


def with_stage_numbers(instr: Column) -> Column:
    """Add ``stage_no`` to each instruction: the FROM it belongs to, counted from 0; null before the first."""
    def numbered(part: Column, stage: Column) -> Column:
        return F.transform(
            part,
            lambda x: F.struct(
                x["line_no"].alias("line_no"), x["inst"].alias("inst"), x["args"].alias("args"), stage.alias("stage_no")
            ),
        )

    def cut(rows: Column, froms: Column) -> Column:
        # Slices between one FROM and the next: linear in the file, with no running count.
        end = F.size(rows) + 1
        before = F.slice(rows, F.lit(1), F.coalesce(F.get(froms, F.lit(0)), end) - 1)
        stages_ = F.transform(
            froms, lambda at, k: numbered(F.slice(rows, at, F.coalesce(F.get(froms, k + 1), end) - at), k)
        )
        return F.concat(numbered(before, F.lit(None).cast("int")), F.flatten(stages_))

    return let(
        instr,
        lambda rows: let(
            F.array_compact(F.transform(rows, lambda x, i: F.when(x["inst"] == "FROM", i + 1))),
            lambda froms: cut(rows, froms),
        ),
    )


def with_instructions(files: DataFrame, join_continuations: bool = False) -> DataFrame:
    """Add the ``instr`` array to Dockerfile rows."""
    return files.withColumn("instr", instructions(F.col("text"), join_continuations))


def docker_instructions(files: DataFrame, join_continuations: bool = False) -> DataFrame:
    """(path, ord, line_no, inst, args, stage_no): one row per instruction."""
    cut = with_instructions(files, join_continuations)
    return cut.select("path", F.posexplode(with_stage_numbers(F.col("instr"))).alias("ord", "x")).select("path", "ord", "x.*")


def _stage_name(x: Column, stage: Column) -> Column:
    """The name after AS in any case, else ``stage<n>``."""
    named = F.regexp_extract(x["args"], r"(?iU)(?:^|\s)AS\s+(\S+)", 1)
    return let(named, lambda n: F.when(n != "", n).otherwise(F.concat(F.lit("stage"), stage)))


def _froms(instr: Column) -> Column:
    return F.filter(instr, lambda x: x["inst"] == "FROM")


def stages(instr: Column) -> Column:
    """array<struct<stage_no, stage_name, base>>: one for each FROM."""
    def one(x: Column, stage: Column) -> Column:
        base = F.regexp_extract(x["args"], r"(?U)^(\S+)", 1)
        return F.struct(
            stage.alias("stage_no"), _stage_name(x, stage).alias("stage_name"), F.when(base != "", base).alias("base")
        )

    return F.transform(_froms(instr), one)


def stage_names(instr: Column) -> Column:
    """The names of ``stages`` alone."""
    return F.transform(_froms(instr), _stage_name)


def docker_stages(files: DataFrame) -> DataFrame:
    """(path, stage_no, stage_name, base): one row per FROM."""
    return with_instructions(files).select("path", F.inline(stages(F.col("instr"))))


def _written(x: Column) -> Column:
    return F.concat(x["inst"], F.lit(" "), x["args"])


def _stage_names(instr: Column) -> Column:
    return F.array_join(stage_names(instr), ", ")


def structure(instr: Column) -> Column:
    """``stages:`` line if there are stages, then the sorted distinct instruction types."""
    used = F.array_join(F.array_sort(F.array_distinct(F.transform(instr, lambda x: x["inst"]))), " ")
    return F.concat_ws(
        "\n",
        let(_stage_names(instr), lambda s: F.when(s != "", F.concat(F.lit("stages: "), s))),
        F.concat(F.lit("instructions: "), used),
    )


def skeleton(instr: Column) -> Column:
    kept = F.filter(instr, lambda x: x["inst"].isin(SKELETON_INSTRUCTIONS))
    return join_or(F.transform(kept, _written), messages.EMPTY)


def base_images(instr: Column) -> Column:
    return join_or(F.transform(F.filter(instr, lambda x: x["inst"] == "FROM"), _written), messages.NO_FROM)


def body(instr: Column, name: Column) -> Column:
    """All instructions of that type, else the first stage of that name, else null."""
    of_type = let(F.upper(name), lambda kind: F.filter(instr, lambda x: x["inst"] == kind))

    def slice_of(nth: Column) -> Column:
        """From the ``nth`` FROM, counted from 1, to the next or the end; null where that is 0 or null."""
        froms = F.array_compact(F.transform(instr, lambda x, i: F.when(x["inst"] == "FROM", i + 1)))
        end = F.size(instr) + 1
        cut = let(froms, lambda at: F.slice(
            instr, F.get(at, nth - 1), F.coalesce(F.get(at, nth), end) - F.get(at, nth - 1)))
        return F.when(nth > 0, cut)

    of_stage = let(F.array_position(stage_names(instr), name).cast("int"), slice_of)

    def text(rows: Column) -> Column:
        return let(rows, lambda r: F.when(F.size(r) > 0, F.array_join(F.transform(r, _written), "\n")))

    return let(text(of_type), lambda found: F.when(found.isNotNull(), found).otherwise(text(of_stage)))


def missing(instr: Column, name: Column) -> Column:
    """What to answer when ``body`` is null."""
    known = let(_stage_names(instr), lambda s: F.when(s != "", s).otherwise(F.lit("none")))
    return F.concat(F.lit("Stage '"), name, F.lit("' not found. Stages: "), known)
