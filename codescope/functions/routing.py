"""Which kind of file a path names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes per kind, language ids, and the order in which they are listed to the user.
PYTHON_SUFFIXES = [".py"]
SCRIPT_SUFFIXES = [".ts", ".tsx", ".js", ".jsx", ".svelte"]
CONFIG_SUFFIXES = [".json", ".yml", ".yaml", ".dockerfile"]
LANGUAGE_IDS = {
    ".py": "python",
    ".ts": "typescript",
    ".tsx": "typescriptreact",
    ".js": "javascript",
    ".jsx": "javascriptreact",
}
SUPPORTED_TEXT = " ".join(sorted(PYTHON_SUFFIXES + SCRIPT_SUFFIXES + CONFIG_SUFFIXES)) + " Dockerfile"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Last dotted part of the name with its dot, empty for ``.hidden`` and ``name.``."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def file_kind(path: Column) -> Column:
    """``python``, ``script``, ``json``, ``yaml``, ``dockerfile`` or null; the suffix is tested before the name."""
    ext, name = F.lower(suffix(path)), F.lower(file_name(path))
    return (
        F.when(ext.isin(PYTHON_SUFFIXES), "python")
        .when(ext.isin(SCRIPT_SUFFIXES), "script")
        .when((name == "dockerfile") | name.startswith("dockerfile.") | (ext == ".dockerfile"), "dockerfile")
        .when(ext.isin(".yml", ".yaml"), "yaml")
        .when(ext == ".json", "json")
    )


def language_id(path: Column) -> Column:
    """Editor language id of a source file, ``plaintext`` for everything else."""
    ext = F.lower(suffix(path))
    found = F.coalesce(*[F.when(ext == s, F.lit(name)) for s, name in LANGUAGE_IDS.items()])
    return F.coalesce(found, F.lit("plaintext"))


def language_family(path: Column) -> Column:
    """``python`` or ``typescript`` for files with semantic support, else ``unknown``."""
    return (
        F.when(language_id(path) == "python", "python")
        .when(language_id(path) == "plaintext", "unknown")
        .otherwise("typescript")
    )
