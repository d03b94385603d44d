"""Modules of scripts: what they import and export, which files that means, and where a declaration is used."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import messages
from ..plans.joins import file_join, fits_broadcast, list_join, restrict_to_paths
from ..plans.lineage import stored
from . import script_symbols
from .script_symbols import _quieted, scan_scripts, script_text

_ID = r"[\p{L}\p{N}_$]+"
#: What a relative import may leave out, nearest first; ``.js`` may stand for the file it is compiled from.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".svelte", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
CLAUSE = "struct<name:string,local:string,exported:string>"
_FROM = r"""(?:\bfrom|^import) ?(["'])(.*?)\1 ?(?:(?:with|assert) ?\{.*\} ?)?$"""
_REQUIRE = rf"""^(?:export )?(?:const|let|var) (.*?) ?= ?require ?\( ?(["'])(.*?)\2 ?\)"""
_LISTED = r"^(?:import|export) (?:type )?(?:[^{}]*, ?)?\{(.*)\}"
_WORD = re.compile(r"(?:(\?\.|(?<!\.)\.)\s*)?((?:[^\W\d]|\$)[\w$]*)")
USE = "struct<name:string,dotted:boolean,line_no:int>"


def _clause(name: Column, local: Column | None = None, exported: Column | None = None) -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct(
        name.alias("name"), (nothing if local is None else local).alias("local"),
        (nothing if exported is None else exported).alias("exported"),
    )


def _listed(text: Column, sign: str, exporting: Column) -> Column:
    """Clauses of ``a, b as c`` (or ``a, b: c``): imported under the second name, or exported under it."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")

    def one(part: Column) -> Column:
        name = F.regexp_extract(part, rf"^(?:type )?[\"']?({_ID})", 1)
        second = F.coalesce(F.nullif(F.regexp_extract(part, rf"{sign} ?[\"']?({_ID})", 1), F.lit("")), name)
        nothing = F.lit(None).cast("string")
        return _clause(name, F.when(exporting, nothing).otherwise(second), F.when(exporting, second))

    return F.filter(F.transform(parts, one), lambda c: c["name"] != "")


def _module(x: Column) -> Column:
    """The module that an import, a re-export or a ``require`` names, else null."""
    head = x["head"]
    opening = head.rlike(rf"^import\b(?! ?[(.])(?! (?:type )?{_ID} ?=)|^export (?:type )?[*{{]")
    found = F.when(opening, F.regexp_extract(head, _FROM, 2)).otherwise(F.regexp_extract(head, _REQUIRE, 3))
    return F.nullif(found, F.lit(""))


def _clauses(x: Column) -> Column:
    """array<clause> of one statement: imported names with what they are called here, exported ones with what they are
    called elsewhere. ``*`` is the whole module."""
    head = x["head"]
    kinds = f"array<{CLAUSE}>"
    none = F.array().cast(kinds)

    def captured(pattern: str, build) -> Column:
        found = F.regexp_extract(head, pattern, 1)
        return F.when(found != "", F.array(build(found)).cast(kinds)).otherwise(none)

    exporting = head.startswith("export")
    named = F.when(head.rlike(_LISTED), _listed(F.regexp_extract(head, _LISTED, 1), r"\bas\b", exporting).cast(kinds)).otherwise(none)
    imported = F.concat(
        captured(rf"^import (?:type )?({_ID}) ?(?:,|from\b)", lambda n: _clause(F.lit("default"), n)),
        captured(rf"^import (?:type )?(?:{_ID} ?, ?)?\* ?as ({_ID})", lambda n: _clause(F.lit("*"), n)),
        named,
    )
    reexported = F.concat(
        F.when(head.rlike(r"^export (?:type )?\* ?from\b"), F.array(_clause(F.lit("*"), None, F.lit("*"))).cast(kinds)).otherwise(none),
        captured(rf"^export (?:type )?\* ?as ({_ID}) ?from\b", lambda n: _clause(F.lit("*"), None, n)),
        named,
    )
    target = F.regexp_extract(head, _REQUIRE, 1)
    required = F.when(target.startswith("{"), _listed(F.regexp_extract(target, r"^\{(.*)\}", 1), ":", F.lit(False)).cast(kinds)).otherwise(
        F.array(_clause(F.lit("*"), F.regexp_extract(target, rf"^({_ID})", 1))).cast(kinds)
    )
    own = F.transform(script_symbols.statement_names(x), lambda n: _clause(n, None, n)).cast(kinds)
    default = F.regexp_extract(head, rf"^export default (?:async )?(?!(?:function|class)\b(?! ?\*? ?{_ID}))(?:(?:abstract )?class |function ?\*? ?)?(?!extends\b)({_ID})", 1)
    declared = (
        F.when(head.rlike(r"^export default\b"), F.when(default != "", F.array(_clause(default, None, F.lit("default"))).cast(kinds)).otherwise(none))
        .when(head.rlike(r"^export (?:type )?\{"), named)
        .when(exporting, own)
        .otherwise(none)
    )
    return (
        F.when(head.rlike(_REQUIRE), F.concat(required, F.when(exporting, own).otherwise(none)))
        .when(_module(x).isNull(), declared)
        .when(exporting, reexported)
        .otherwise(imported)
    )


def module_clauses(scanned: DataFrame) -> DataFrame:
    """(path, start_line, end_line, module, name, local, exported): one row per imported or exported name.

    ``module`` is null for what a file exports of its own. A name that is imported has ``local``, one that is exported
    ``exported``; ``*`` is everything a module exports, ``default`` its default. An import for its effect alone has
    one row without names.
    """
    each = scanned.select("path", F.explode("statements").alias("x")).where(
        F.col("x.head").rlike(r"^(?:import|export)\b|\brequire ?\(")
    )
    rows = each.select(
        "path", "x.start_line", "x.end_line", _module(F.col("x")).alias("module"), _clauses(F.col("x")).alias("clauses")
    )
    return rows.select("path", "start_line", "end_line", "module", F.inline_outer("clauses")).where(
        "module IS NOT NULL OR name IS NOT NULL"
    )


def script_imports_table(scanned: DataFrame) -> DataFrame:
    """``module_clauses`` that name a module: imports, re-exports and ``require`` calls."""
    return module_clauses(scanned).where("module IS NOT NULL")


def _joined(directory: Column, module: Column) -> Column:
    """The path that a relative module names from ``directory``, without ``.`` and ``..``; null above the root."""
    def step(path: Column, part: Column) -> Column:
        up = F.when(F.size(path) > 0, F.slice(path, F.lit(1), F.size(path) - 1))
        return F.when((part == "") | (part == "."), path).when(part == "..", up).otherwise(F.concat(path, F.array(part)))

    parts = F.split(F.concat(directory, module), "/")
    found = F.aggregate(parts, F.array().cast("array<string>"), step)
    root = F.when(directory.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(root, F.array_join(found, "/"))


def resolve_script_modules(wanted: DataFrame, paths: DataFrame) -> DataFrame:
    """(dir, module, target) for each relative module of ``wanted(dir, module)`` that is a file of ``paths(path)``.

    A name is tried as it is, then with each of ``ENDINGS``; a ``.js`` at its end also as ``.ts``. Pairs are tried once
    however many files import them, and meet the files in a join whose hot sides are salted.
    """
    base = _joined(F.col("dir"), F.col("module"))
    base_or_root = F.when(F.col("base").isin("", "/"), F.lit("")).otherwise(F.col("base"))
    plain = F.array(*[F.when(F.col("base") == "", F.lit(e.lstrip("/"))).otherwise(F.concat(base_or_root, F.lit(e))) for e in ENDINGS])
    source = F.regexp_replace("base", r"\.js(x?)$", r".ts$1")
    places = F.when(F.col("base").rlike(r"\.jsx?$"), F.concat(plain, F.array(source))).otherwise(plain)
    tried = wanted.where(F.col("module").rlike(r"^\.{1,2}(/|$)")).select("dir", "module", base.alias("base")).where(
        "base IS NOT NULL"
    ).select("dir", "module", F.posexplode(places).alias("rank", "path"))
    met = list_join(paths.select("path"), tried, ["path"])
    first = F.row_number().over(Window.partitionBy("dir", "module").orderBy("rank"))
    return met.withColumn("nth", first).where("nth = 1").select("dir", "module", F.col("path").alias("target"))


def _uses(texts: pa.Array) -> pa.Array:
    rows = []
    for text in texts.to_pylist():
        found = set()
        if text is not None:
            for number, line in enumerate(_quieted(text)[1].split("\n"), start=1):
                found.update((m[2], m[1] is not None, number) for m in _WORD.finditer(line))
        rows.append(sorted(found))
    return pa.array(rows, pa.list_(pa.struct([("name", pa.string()), ("dotted", pa.bool_()), ("line_no", pa.int32())])))


_uses.__annotations__ = {"texts": pa.Array, "return": pa.Array}


def script_uses(files: DataFrame) -> DataFrame:
    """(path, name, dotted, line_no) of every name in the code of scripts, once per line; not in comments, strings or
    templates. ``dotted`` names stand behind a dot."""
    words = F.arrow_udf(_uses, f"array<{USE}>").asNondeterministic()(script_text(F.col("path"), F.col("text")))
    return files.select("path", F.inline(words))


_HOLDER = ["symbol", "def_path", "path", "exported"]
_WAY = ["symbol", "def_path", "path", "name", "dotted", "from_line", "to_line"]
_LAST_LINE = 2**31 - 1


def _ways(frame: DataFrame, name: Column, dotted: bool = False, from_line: Column | None = None, to_line: Column | None = None) -> DataFrame:
    return frame.select(
        "symbol", "def_path", "path", name.alias("name"), F.lit(dotted).alias("dotted"),
        (F.lit(1) if from_line is None else from_line).alias("from_line"),
        (F.lit(_LAST_LINE) if to_line is None else to_line).alias("to_line"),
    )


def _exported(bound: DataFrame, exports: DataFrame) -> DataFrame:
    """Holders for what files export of the names ``bound(symbol, def_path, path, local)`` in them."""
    met = file_join(exports.select("path", F.col("name").alias("local"), "exported"), bound, ["path", "local"], fits_broadcast(bound))
    return met.select(_HOLDER)


def script_resolved_references(files: DataFrame, requests: DataFrame) -> DataFrame:
    """(req_id, symbol, path, line_no, status, message) for ``requests(req_id, symbol, path)`` of scripts.

    A top-level declaration of the given file is followed through imports, renamings, re-exports and ``export *`` of
    scripts until no new file appears. It counts where its name stands in code: in its own file, under the local name in
    files that import it, behind a dot in files that import the module as a whole, and where an import or export names
    it. Scripts are read lexically, so a parameter of the same name counts too, and the insides of templates do not. A
    request without a hit is one row with status ``no_references``; equal requests give equal rows.

    Every script is scanned once for its clauses; only files that hold the symbol are read again for its uses.
    """
    scripts = files.where(F.col("kind") == "script").select("path", "kind", "text")
    scanned = scan_scripts(scripts)
    facts = stored(scanned.select("path", "statements"))
    clauses = stored(module_clauses(facts))
    exports = stored(clauses.where("module IS NULL").select("path", "name", "exported"))
    imports = clauses.where("module IS NOT NULL AND name IS NOT NULL").withColumn("dir", F.regexp_replace("path", "[^/]*$", ""))
    targets = stored(resolve_script_modules(stored(imports.select("dir", "module").distinct()), scripts.select("path")))
    edges = stored(list_join(imports, targets, ["dir", "module"]).select(
        "path", "target", "name", "local", "exported", "start_line", "end_line"))

    asked = requests.select("symbol", F.col("path").alias("def_path")).where("symbol IS NOT NULL AND path IS NOT NULL").distinct()
    declared = facts.select(F.col("path").alias("def_path"), F.explode(F.flatten(F.transform("statements", script_symbols.statement_names))).alias("symbol"))
    small = fits_broadcast(asked)
    located = stored(file_join(declared, asked, ["def_path", "symbol"], small).distinct())
    own = located.select("symbol", "def_path", F.col("def_path").alias("path"), F.col("symbol").alias("local"))
    ways = [_ways(own, F.col("local"))]
    known = frontier = stored(_exported(own, exports).distinct())
    while not frontier.isEmpty():
        given = frontier.select("symbol", "def_path", F.col("path").alias("target"), F.col("exported").alias("given"))
        few = fits_broadcast(given)
        named = list_join(edges.where("name <> '*'"), given.withColumn("name", F.col("given")), ["target", "name"], few)
        whole = list_join(edges.where("name = '*'"), given, ["target"], few)
        met = stored(named.unionByName(whole))
        one = F.col("name") != "*"
        bound = met.where(one & F.col("local").isNotNull())
        ways += [
            _ways(bound, F.col("local")),
            _ways(met.where(one), F.col("name"), False, F.col("start_line"), F.col("end_line")),
            _ways(met.where(~one & F.col("local").isNotNull()), F.col("given"), True),
        ]
        passed = met.where(one & F.col("exported").isNotNull()).unionByName(
            met.where(~one & (F.col("exported") == "*") & (F.col("given") != "default")).withColumn("exported", F.col("given"))
        ).select(_HOLDER)
        again = _exported(bound.select("symbol", "def_path", "path", "local"), exports)
        frontier = stored(passed.unionByName(again).distinct().join(known, _HOLDER, "left_anti"))
        known = known.unionByName(frontier)

    ways = stored(reduce(DataFrame.unionByName, ways).distinct())
    few = fits_broadcast(ways)
    holders = ways.select("path").distinct()
    uses = script_uses(restrict_to_paths(scripts, holders, few))
    hits = file_join(uses, ways, ["path", "name", "dotted"], few).where("line_no BETWEEN from_line AND to_line").select(
        "symbol", "def_path", "path", "line_no").distinct()
    wanted = requests.select("req_id", "symbol", F.col("path").alias("def_path"))
    hits = stored(hits)
    found = list_join(hits, wanted, ["symbol", "def_path"], fits_broadcast(wanted)).select(
        "req_id", "symbol", "path", "line_no", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("message"))
    silent = wanted.join(hits.select("symbol", "def_path").distinct(), ["symbol", "def_path"], "left_anti")
    return found.unionByName(
        silent.select("req_id", "symbol", F.lit("no_references").alias("status"), F.lit(messages.NO_REFERENCES).alias("message")),
        allowMissingColumns=True,
    )
