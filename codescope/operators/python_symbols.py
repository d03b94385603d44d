"""Definitions and imports of Python files.

One row-local stage parses each file with the standard library; everything it finds stays nested in that file's row,
so listings, bodies and lookups are column expressions on the row and need no shuffle.
"""

from __future__ import annotations

import ast
import warnings
from collections import deque
from collections.abc import Collection
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import by_slices, read_back, written
from ..functions.text import let, normalize_newlines
from .python_scopes import Scopes

SYMBOL = (
    "ord int, bfs_ord int, name string, kind string, is_async boolean, parent string, parent_ord int, top_name string,"
    " depth int, listed boolean, first_named boolean, start_line int, end_line int, name_col int, body_off int, body_len int,"
    " arguments string, returns string, bases array<string>, doc_full string, first_line string, next_line string,"
    " scope int"
)
IMPORT = (
    "ord int, start_line int, end_line int, text string, module string, names array<string>,"
    " aliases array<string>, name_lines array<int>, top_level boolean, scope int"
)
USE = "name string, dotted boolean, line_no int, base string, scope int"
NAMED = "name string, depth int"
PARSED = f"error string, symbols array<struct<{SYMBOL}>>, imports array<struct<{IMPORT}>>, uses array<struct<{USE}>>"


def _fields(ddl: str) -> list[tuple[str, pa.DataType]]:
    kinds = {
        "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()),
        "array<int>": pa.list_(pa.int32()),
    }
    return [(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(","))]


_ARROW = pa.struct(
    [
        ("error", pa.string()),
        ("symbols", pa.list_(pa.struct(_fields(SYMBOL)))),
        ("imports", pa.list_(pa.struct(_fields(IMPORT)))),
        ("uses", pa.list_(pa.struct(_fields(USE)))),
    ]
)
_NAMED_ARROW = pa.list_(pa.struct(_fields(NAMED)))


def _plain(text: str | None) -> str | None:
    """Text that UTF-8 can hold: lone surrogates (from escapes in literals) stay written as escapes."""
    if text is None or text.isascii():
        return text
    return text.encode("utf-8", "backslashreplace").decode("utf-8")


# The fields that hold statements, by kind of node; expressions never hold any.
_BLOCKS = {
    kind: tuple(f for f in kind._fields if f in ("body", "handlers", "orelse", "finalbody", "cases"))
    for kind in (*ast.stmt.__subclasses__(), ast.ExceptHandler, ast.match_case)
}
_DEFINITIONS = frozenset((ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef))


def _statements(node: ast.AST) -> list[ast.AST]:
    """Child nodes that can hold definitions, in source order. Expressions never do, so they are not visited."""
    return [child for field in _BLOCKS[type(node)] for child in getattr(node, field)]


def _simple(node: ast.expr) -> str | None:
    """What ``ast.unparse`` gives for a name, an attribute of one or a plain constant; null for all else."""
    if type(node) is ast.Name:
        return node.id
    if type(node) is ast.Constant:
        plain = type(node.value) in (int, bool, type(None)) or (type(node.value) is str and node.kind is None)
        return repr(node.value) if plain else None
    if type(node) is ast.Attribute and type(node.value) is ast.Name:
        return f"{node.value.id}.{node.attr}"
    return None


def _unparsed(node: ast.expr) -> str:
    simple = _simple(node)
    return ast.unparse(node) if simple is None else simple


def _arguments(node: ast.arguments) -> str:
    """``ast.unparse`` of arguments, put together here where they are simple ones."""
    if node.posonlyargs or node.vararg or node.kwonlyargs or node.kwarg:
        return ast.unparse(node)
    parts, first_default = [], len(node.args) - len(node.defaults)
    for at, arg in enumerate(node.args):
        part = arg.arg
        if arg.annotation:
            shown = _simple(arg.annotation)
            if shown is None:
                return ast.unparse(node)
            part += f": {shown}"
        if at >= first_default:
            shown = _simple(node.defaults[at - first_default])
            if shown is None:
                return ast.unparse(node)
            part += f"={shown}"
        parts.append(part)
    return ", ".join(parts)


def _signature(node: ast.stmt) -> tuple[str | None, str | None, list[str] | None, str | None]:
    """Source of a definition's arguments, returned annotation and bases, and its docstring; all null if too deep."""
    try:
        doc = ast.get_docstring(node, clean=False)
        if isinstance(node, ast.ClassDef):
            return None, None, [_plain(_unparsed(base)) for base in node.bases], _plain(doc)
        returns = node.returns and _plain(_unparsed(node.returns))
        return _plain(_arguments(node.args)), returns, None, _plain(doc)
    except Exception:  # noqa: BLE001 - an expression nested too deep must not end the job
        return None, None, None, None


def _parse_one(source: str, signatures: bool, uses: bool = False, only: Collection[str | None] | None = None) -> tuple:
    """(error, symbols, imports, uses) of one file. Symbols come in source order, with their breadth-first rank.

    With ``uses``, symbols and imports also tell the scope that they bind a name in. With ``only`` the first symbol of
    each of these names comes, and no imports.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except Exception as problem:  # noqa: BLE001 - no file may end the job
        return _plain(str(problem) or type(problem).__name__), [], [], []

    scopes = Scopes(tree) if uses else None
    home = scopes.home if scopes else {}
    lines = source.split("\n")
    starts = [0, *accumulate(len(line) + 1 for line in lines)]
    found: list[dict] = []
    imports: list[tuple] = []
    # Breadth-first; ``direct`` tells whether a statement stands right in its owner's body, not in an if or try there.
    queue: deque = deque((child, None, True) for child in tree.body)
    while queue:
        node, owner, direct = queue.popleft()
        if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            is_class = isinstance(node, ast.ClassDef)
            in_class = direct and owner is not None and owner["kind"] == "class"
            on_top = direct and owner is None
            word = "class " if is_class else "async def " if isinstance(node, ast.AsyncFunctionDef) else "def "
            owner = {
                "node": node,
                "bfs": len(found),
                "owner": owner,
                "depth": 0 if owner is None else owner["depth"] + 1,
                "top": node.name if owner is None else owner["top"],
                "kind": "class" if is_class else "method" if in_class else "function",
                "on_top": on_top,
                "listed": on_top or (in_class and not is_class and owner["on_top"]),
                "col": node.col_offset + len(word),
            }
            found.append(owner)
        elif only is None and isinstance(node, ast.Import | ast.ImportFrom):
            from_module = None
            if isinstance(node, ast.ImportFrom):
                from_module = "." * node.level + (node.module or "")
            text = "\n".join(lines[node.lineno - 1 : node.end_lineno])
            names, aliases = [alias.name for alias in node.names], [alias.asname for alias in node.names]
            name_lines = [alias.lineno for alias in node.names]
            imports.append(
                (node.lineno, node.col_offset, node.end_lineno, text, from_module, names, aliases, name_lines,
                 direct and owner is None, home.get(node))
            )
        inside = owner is not None and owner["node"] is node
        queue.extend((child, owner, inside) for child in _statements(node))

    seen: set[str] = set()
    for symbol in found:
        symbol["first"] = symbol["node"].name not in seen
        seen.add(symbol["node"].name)
    found.sort(key=lambda s: (s["node"].lineno, s["node"].col_offset))
    for rank, symbol in enumerate(found):
        symbol["ord"] = rank
    if only is not None:
        asked = set(only)
        found = [s for s in found if s["first"] and s["node"].name in asked]
    symbols = []
    for s in found:
        node, parent = s["node"], s["owner"]
        start, end = node.lineno, node.end_lineno
        offset = starts[start - 1]
        symbols.append(
            (
                s["ord"], s["bfs"], node.name, s["kind"], isinstance(node, ast.AsyncFunctionDef),
                parent and parent["node"].name, parent and parent["ord"], s["top"], s["depth"], s["listed"], s["first"],
                start, end, s["col"], offset, starts[end] - 1 - offset,
                *(_signature(node) if signatures else (None, None, None, None)),
                lines[start - 1] if signatures else None,
                lines[start] if signatures and start < len(lines) else None,
                home.get(node),
            )
        )
    imports.sort(key=lambda i: i[:2])
    return None, symbols, [(n, i[0], *i[2:]) for n, i in enumerate(imports)], scopes.uses() if scopes else []


def _parser(signatures: bool, uses: bool, asked: bool = False):
    def rows(texts: pa.Array) -> pa.Array:
        return pa.array([None if text is None else _parse_one(text, signatures, uses) for text in texts.to_pylist()], _ARROW)

    def parse(texts: pa.Array) -> pa.Array:
        return pa.nulls(len(texts), _ARROW) if texts.null_count == len(texts) else by_slices(rows, texts)

    def asked_rows(texts: pa.Array, asked: pa.Array) -> pa.Array:
        each = zip(texts.to_pylist(), read_back(asked), strict=True)
        return pa.array([None if text is None else _parse_one(text, signatures, uses, names) for text, names in each], _ARROW)

    def parse_asked(texts: pa.Array, asked: pa.Array) -> pa.Array:
        return pa.nulls(len(texts), _ARROW) if texts.null_count == len(texts) else by_slices(asked_rows, texts, asked)

    parse.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    parse_asked.__annotations__ = {**parse.__annotations__, "asked": pa.Array}
    # Not deterministic as far as the optimizer is told: otherwise filters on the result are pushed below it and
    # every file is parsed once for the filter and again for the projection.
    return F.arrow_udf(parse_asked if asked else parse, PARSED).asNondeterministic()


def parsed_python(text: Column, signatures: bool = True, uses: bool = False, names: Column | None = None) -> Column:
    """Parse a text column; null text gives null. ``signatures=False`` skips headers, docs and raw lines; ``uses`` adds
    the lines of all names and the scopes that they are bound in. With ``names``, an array in each row, only the first
    symbols of these names come out."""
    plain = normalize_newlines(text)
    if names is None:
        return _parser(signatures, uses)(plain)
    return _parser(signatures, uses, True)(plain, written(names, text.isNotNull()))


def _defined_one(source: str) -> list[tuple[str, int]]:
    """(name, nesting depth) of the first definition of each name, breadth-first as in ``_parse_one``; none on an error."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except Exception:  # noqa: BLE001 - no file may end the job
        return []
    first: dict[str, int] = {}
    queue: deque = deque((child, 0) for child in tree.body)
    while queue:
        node, depth = queue.popleft()
        kind = type(node)
        if kind in _DEFINITIONS:
            first.setdefault(node.name, depth)
            depth += 1
        for field in _BLOCKS[kind]:
            queue.extend([(child, depth) for child in getattr(node, field)])
    return list(first.items())


def _defined(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _defined_one(t) for t in texts.to_pylist()], _NAMED_ARROW)


def _define(texts: pa.Array) -> pa.Array:
    return pa.nulls(len(texts), _NAMED_ARROW) if texts.null_count == len(texts) else by_slices(_defined, texts)


_define.__annotations__ = {"texts": pa.Array, "return": pa.Array}


def defined_python(text: Column) -> Column:
    """array<struct<name, depth>>: each name that a text defines, with the nesting depth of its first definition."""
    return F.arrow_udf(_define, f"array<struct<{NAMED}>>").asNondeterministic()(normalize_newlines(text))


def parse_python(files: DataFrame, signatures: bool = True, uses: bool = False) -> DataFrame:
    """Files with ``parsed`` (error, symbols, imports, uses). Filter files before this, not after."""
    return files.withColumn("parsed", parsed_python(F.col("text"), signatures, uses))


def symbols_table(parsed: DataFrame) -> DataFrame:
    """One row per class or function at any depth."""
    rows = parsed.select("path", F.explode("parsed.symbols").alias("s"))
    return rows.select("path", "s.*", header(F.col("s")).alias("header"), doc_first(F.col("s")).alias("doc_first"))


def header(symbol: Column) -> Column:
    """``class Name(Bases):`` or ``def name(arguments) -> returned: ...``; null without a signature."""
    bases = F.when(F.size(symbol["bases"]) > 0, F.concat(F.lit("("), F.array_join(symbol["bases"], ", "), F.lit(")")))
    opening = F.when(symbol["is_async"], F.lit("async def ")).otherwise(F.lit("def "))
    returned = F.coalesce(F.concat(F.lit(" -> "), symbol["returns"]), F.lit(""))
    return F.when(
        symbol["bases"].isNotNull(), F.concat(F.lit("class "), symbol["name"], F.coalesce(bases, F.lit("")), F.lit(":"))
    ).otherwise(F.concat(opening, symbol["name"], F.lit("("), symbol["arguments"], F.lit(")"), returned, F.lit(": ...")))


def doc_first(symbol: Column) -> Column:
    """The first line of the docstring without the white space around it."""
    return F.regexp_replace(F.substring_index(symbol["doc_full"], "\n", 1), r"(?U)\A\s+|\s+\z", "")


def imports_table(parsed: DataFrame) -> DataFrame:
    """One row per import statement at any depth."""
    return parsed.select("path", F.inline("parsed.imports")).drop("scope")


def parse_status(parsed: DataFrame) -> DataFrame:
    """(path, status, error): ``parse_error`` for files the parser rejects."""
    status = F.when(F.col("parsed.error").isNotNull(), "parse_error").otherwise("ok")
    return parsed.select("path", status.alias("status"), F.col("parsed.error").alias("error"))


def symbol_tree(parsed: DataFrame) -> DataFrame:
    """(path, parent, parent_line, child, kind) for every definition inside another one."""
    each = parsed.select(
        "path",
        F.inline(
            let(
                F.col("parsed.symbols"),
                lambda symbols: F.transform(
                    F.filter(symbols, lambda s: s["parent_ord"].isNotNull()),
                    lambda s: F.struct(
                        s["parent"].alias("parent"),
                        F.get(symbols, s["parent_ord"])["start_line"].alias("parent_line"),
                        s["name"].alias("child"),
                        s["kind"].alias("kind"),
                    ),
                ),
            )
        ),
    )
    return each
