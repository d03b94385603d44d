"""JSON and YAML files: top-level keys, previews, values by key, ``$ref`` targets, anchors and includes.

The parsers run in one row-local stage. They are the standard JSON module and PyYAML, because what is shown depends on
them: key order, the last of duplicate keys, number and string formatting, YAML 1.1 typing. All views are expressions.
"""

from __future__ import annotations

import json
from collections.abc import Container

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import messages
from ..functions.batches import by_slices, read_back, written
from ..functions.text import WORD, join_or, let, normalize_newlines

ENTRY = (
    "ord int, key string, value_type string, n_children int, value_repr string, value_json string, body string"
)
PARSED = f"error string, root_type string, n_items int, root_repr string, entries array<struct<{ENTRY}>>"
_ARROW = pa.struct(
    [
        ("error", pa.string()),
        ("root_type", pa.string()),
        ("n_items", pa.int32()),
        ("root_repr", pa.string()),
        (
            "entries",
            pa.list_(
                pa.struct(
                    [
                        ("ord", pa.int32()), ("key", pa.string()), ("value_type", pa.string()),
                        ("n_children", pa.int32()), ("value_repr", pa.string()), ("value_json", pa.string()),
                        ("body", pa.string()),
                    ]
                )
            ),
        ),
    ]
)
# What is looked for in raw text, and lengths of previews in characters.
REF_TARGET = r'(?U)"\$ref"\s*:\s*"([^"]+)"'
ANCHOR = f"&({WORD}+)"
INCLUDE = r"(?U)!include\s+(\S+)"
VALUE_PREVIEW = 80
ROOT_PREVIEW = 200

_FAST_YAML = getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def _plain(text: str) -> str:
    return text if text.isascii() else text.encode("utf-8", "backslashreplace").decode("utf-8")


def _load_yaml(text: str) -> object:
    try:
        return yaml.load(text, Loader=_FAST_YAML)
    except yaml.YAMLError:
        return yaml.safe_load(text)  # the same failure, worded by the loader in Python


_LOADERS = {"json": json.loads, "yaml": _load_yaml}
_DUMPERS = {
    "json": lambda value: json.dumps(value, indent=2),
    "yaml": lambda value: yaml.dump(value, default_flow_style=False).rstrip(),
}


def _shares_nodes(value: object) -> bool:
    """Whether a container occurs twice in ``value``, as YAML aliases make it; written out it could grow without bound."""
    seen, waiting = set(), [value]
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict | list):
            if id(node) in seen:
                return True
            seen.add(id(node))
            waiting.extend(node.values() if isinstance(node, dict) else node)
    return False


def _json_keys(value: object) -> object:
    """``value`` with the keys of all objects as text."""
    if isinstance(value, dict):
        return {str(k): _json_keys(v) for k, v in value.items()}
    return [_json_keys(v) for v in value] if isinstance(value, list) else value


def _compact(value: object, kind: str) -> str | None:
    if kind == "yaml":
        if _shares_nodes(value):
            return None
        value = _json_keys(value)
    return json.dumps(value, default=str, separators=(",", ":"))


def _rendered(render, *value: object) -> str | None:
    """What ``render`` gives, or null for a value that cannot be written; the file's other entries are not touched."""
    try:
        text = render(*value)
        return None if text is None else _plain(text)
    except Exception:  # noqa: BLE001 - whatever a value does to its renderer, it must not end the job
        return None


def _parse_one(text: str, kind: str, bodies: bool, names: Container[str | None] | None = None) -> tuple:
    """(error, root_type, n_items, root_repr, entries); with ``names`` only bodies of these keys are rendered."""
    try:
        root = _LOADERS[kind](text)
    except Exception as problem:  # noqa: BLE001 - constructors of tagged values raise errors of all kinds
        return _plain(str(problem) or type(problem).__name__), None, None, None, []
    kind_name = type(root).__name__
    if isinstance(root, list):
        return None, kind_name, len(root), None, []
    if not isinstance(root, dict):
        return None, kind_name, None, _rendered(repr, root), []
    entries = []
    for position, (key, value) in enumerate(root.items()):
        nested, shown = isinstance(value, dict | list), _rendered(str, key)
        if names is not None:
            body = _rendered(_DUMPERS[kind], value) if bodies and shown in names else None
            entries.append((position, shown, type(value).__name__, None, None, None, body))
            continue
        entries.append(
            (
                position,
                shown,
                type(value).__name__,
                len(value) if nested else None,
                None if nested else _rendered(repr, value),
                _rendered(_compact, value, kind) if bodies else None,
                _rendered(_DUMPERS[kind], value) if bodies else None,
            )
        )
    return None, kind_name, len(root), None, entries


def parsed_config(text: Column, kind: Column, bodies: bool = True, names: Column | None = None) -> Column:
    """Parse by kind (``json`` or ``yaml``); null text gives null. ``bodies=False`` skips rendering the values.

    With ``names``, an array in each row, entries have no more than ``key_body`` and ``missing`` read for these keys.
    """
    def rows(texts: pa.Array, kinds: pa.Array, *asked: pa.Array) -> pa.Array:
        each = zip(texts.to_pylist(), kinds.to_pylist(), *map(read_back, asked), strict=True)
        return pa.array([None if t is None else _parse_one(t, k, bodies, *n) for t, k, *n in each], _ARROW)

    def parse(texts: pa.Array, kinds: pa.Array) -> pa.Array:
        return pa.nulls(len(texts), _ARROW) if texts.null_count == len(texts) else by_slices(rows, texts, kinds)

    def parse_asked(texts: pa.Array, kinds: pa.Array, asked: pa.Array) -> pa.Array:
        return pa.nulls(len(texts), _ARROW) if texts.null_count == len(texts) else by_slices(rows, texts, kinds, asked)

    parse.__annotations__ = {"texts": pa.Array, "kinds": pa.Array, "return": pa.Array}
    parse_asked.__annotations__ = {**parse.__annotations__, "asked": pa.Array}
    inputs = [normalize_newlines(text), kind, *([] if names is None else [written(names, text.isNotNull())])]
    return F.arrow_udf(parse if names is None else parse_asked, PARSED).asNondeterministic()(*inputs)


def parse_config(files: DataFrame, bodies: bool = True) -> DataFrame:
    """JSON and YAML files with ``config`` (error, root_type, n_items, root_repr, entries)."""
    return files.withColumn("config", parsed_config(F.col("text"), F.col("kind"), bodies))


def preview(entry: Column) -> Column:
    """Shape of a nested value, or a literal cut at ``VALUE_PREVIEW`` characters."""
    literal = entry["value_repr"]
    return (
        F.when(entry["value_type"] == "dict", F.concat(F.lit("{...} ("), entry["n_children"], F.lit(" keys)")))
        .when(entry["value_type"] == "list", F.concat(F.lit("[...] ("), entry["n_children"], F.lit(" items)")))
        .when(F.length(literal) > VALUE_PREVIEW, F.concat(F.substring(literal, 1, VALUE_PREVIEW), F.lit("…")))
        .otherwise(literal)
    )


def config_entries(parsed: DataFrame) -> DataFrame:
    """(path, ord, key, value_type, value_json, n_children, preview, body): one row per top-level key.

    ``value_json`` is null for a value with aliases, which JSON cannot hold; ``body`` has them as the dumper writes them.
    Either is null for a value that is nested too deep to be written.
    """
    rows = parsed.select("path", F.explode("config.entries").alias("e"))
    return rows.select(
        "path", "e.ord", "e.key", "e.value_type", "e.value_json", "e.n_children",
        preview(F.col("e")).alias("preview"), "e.body",
    )


def config_roots(parsed: DataFrame) -> DataFrame:
    """(path, root_type, n_items, status)."""
    status = F.when(F.col("config.error").isNotNull(), "parse_error").otherwise("ok")
    return parsed.select("path", "config.root_type", "config.n_items", status.alias("status"))


def _array_shape(config: Column) -> Column:
    return F.concat(F.lit("(array of "), config["n_items"], F.lit(" items)"))


def structure(config: Column) -> Column:
    """Keys, the number of items, or the type name of a scalar."""
    keys = F.transform(config["entries"], lambda e: e["key"])
    return (
        F.when(config["root_type"] == "dict", join_or(keys, messages.EMPTY_OBJECT))
        .when(config["root_type"] == "list", _array_shape(config))
        .otherwise(config["root_type"])
    )


def skeleton(config: Column) -> Column:
    """``key: preview`` lines; an empty object shows nothing."""
    lines = F.transform(config["entries"], lambda e: F.concat(e["key"], F.lit(": "), preview(e)))
    return (
        F.when(config["root_type"] == "dict", F.array_join(lines, "\n"))
        .when(config["root_type"] == "list", _array_shape(config))
        .otherwise(F.substring(config["root_repr"], 1, ROOT_PREVIEW))
    )


def key_body(config: Column, name: Column) -> Column:
    """Rendered value of a top-level key, or null."""
    return F.get(F.filter(config["entries"], lambda e: e["key"] == name), F.lit(0))["body"]


def missing(config: Column, kind: Column, name: Column) -> Column:
    """What to answer when ``key_body`` is null."""
    keys = F.array_join(F.transform(config["entries"], lambda e: e["key"]), ", ")
    root = F.when(kind == "json", "object").otherwise("mapping")
    article = F.when(kind == "json", "an ").otherwise("a ")
    there = F.exists(config["entries"], lambda e: e["key"] == name)
    return F.when(
        (config["root_type"] == "dict") & there, F.concat(F.lit("Value of key '"), name, F.lit("' cannot be written out"))
    ).when(
        config["root_type"] == "dict",
        F.concat(F.lit("Key '"), name, F.lit("' not found. Top-level keys: "), keys),
    ).otherwise(F.concat(F.lit("Cannot look up key '"), name, F.lit("': root is not "), article, root))


def parse_failure(path: Column, kind: Column, config: Column) -> Column:
    """The message for a file that could not be parsed, else null."""
    return F.concat(F.upper(kind), F.lit(" parse error in "), path, F.lit(": "), config["error"])


def _ref_targets(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(REF_TARGET), F.lit(1))


def _anchors(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANCHOR), F.lit(1))


def _includes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(INCLUDE), F.lit(1))


def json_ref_targets(files: DataFrame) -> DataFrame:
    """(path, ord, target): every ``$ref`` string in the raw text, in order."""
    return files.select("path", F.posexplode(_ref_targets(F.col("text"))).alias("ord", "target"))


def yaml_anchors_includes(files: DataFrame) -> DataFrame:
    """(path, kind, ord, name): anchors and includes found in the raw text."""
    found = F.concat(
        F.transform(_anchors(F.col("text")), lambda n, i: F.struct(F.lit("anchor").alias("kind"), i.alias("ord"), n.alias("name"))),
        F.transform(_includes(F.col("text")), lambda n, i: F.struct(F.lit("include").alias("kind"), i.alias("ord"), n.alias("name"))),
    )
    return files.select("path", F.inline(found))


def json_imports(text: Column) -> Column:
    return join_or(_ref_targets(text), messages.NO_JSON_REFS)


def yaml_imports(text: Column) -> Column:
    """An ``anchors:`` line and an ``includes:`` line, each only when there are any."""
    def line(title: str, found: Column) -> Column:
        return let(found, lambda x: F.when(F.size(x) > 0, F.concat(F.lit(title), F.array_join(x, ", "))))

    both = F.array_compact(F.array(line("anchors: ", _anchors(text)), line("includes: ", _includes(text))))
    return join_or(both, messages.NO_ANCHORS)
