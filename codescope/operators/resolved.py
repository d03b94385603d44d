"""Where a definition is used: followed through imports, aliases, re-exports and scopes of Python files.

A *holder* is a file that can use the symbol: it says under which name importers of that file get at it, and which name
stands for the symbol inside the file, in which scope. The defining file is the first; imports of a holder make new ones,
round by round, until no new one appears.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import messages
from ..plans import joins
from ..plans.joins import file_join, fits_broadcast, list_join, restrict_to_paths
from ..plans.lineage import stored
from .python_scopes import MODULE
from .python_symbols import parse_python, symbols_table
from .references import find_references_bulk, words

# Directories, relative to any ancestor of the importing file, from which absolute imports are looked up.
SOURCE_ROOTS = ("", "src", "lib")
_HOLDER = ["symbol", "def_path", "path", "exported", "used", "plain", "dotted", "base", "scope"]


def _places(directory: Column, module: Column) -> Column:
    """Where the module of an import in a file of ``directory`` may be: paths without suffix, nearest first.

    A relative import names one directory. An absolute one is looked up from each ancestor directory of the
    importing file and from the usual source roots below it.
    """
    parts = F.split(directory, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    inner = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.size(dirs) - dots + 1
    relative = F.when(up >= 0, F.array(F.slice(dirs, F.lit(1), F.greatest(up, F.lit(0))))).otherwise(
        F.array().cast("array<array<string>>")
    )
    ancestors = F.transform(F.sequence(F.size(dirs), F.lit(0), F.lit(-1)), lambda n: F.slice(dirs, F.lit(1), n))
    absolute = F.flatten(
        F.transform(ancestors, lambda d: F.array(*[F.concat(d, F.array(F.lit(r))) if r else d for r in SOURCE_ROOTS]))
    )
    bases = F.transform(
        F.when(dots > 0, relative).otherwise(absolute),
        lambda d: F.array_join(F.filter(F.concat(d, F.array(inner)), lambda p: p != ""), "/"),
    )
    absolute_root = F.when(directory.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.transform(bases, lambda b: F.concat(absolute_root, b))


def module_places(python_files: DataFrame) -> DataFrame:
    """(target, place, package): the place at which imports find each file; a package stands behind a module there."""
    path = F.col("path")
    place = F.regexp_replace(path, r"(?:/__init__)?\.py$", "")
    return python_files.select(path.alias("target"), place.alias("place"), path.endswith("/__init__.py").alias("package"))


def _last(name: Column, sign: str) -> Column:
    return F.substring_index(name, sign, -1)


def resolve_modules(wanted: DataFrame, places: DataFrame) -> DataFrame:
    """(dir, module, target) for each of ``wanted(dir, module)`` that names a file of the corpus: the nearest one.

    Files of one directory share the answer, so a pair is looked up once however often it is imported. Where the pairs
    are too many to be broadcast, those whose last component no file of the corpus has (the standard library, say) are
    dropped by a semi-join on it before places are tried, and the rest meet the files in a salted join.
    """
    small = fits_broadcast(wanted)
    if not small:
        stems = places.select(_last(F.col("place"), "/").alias("last")).distinct()
        named = wanted.withColumn("last", _last(F.col("module"), "."))
        wanted = list_join(named.where("last != ''"), stems, ["last"]).select("dir", "module").unionByName(
            named.where("last = ''").select("dir", "module")
        )
    tried = wanted.select("dir", "module", F.posexplode(_places(F.col("dir"), F.col("module"))).alias("rank", "place"))
    met = list_join(places, tried, ["place"], small)
    order = Window.partitionBy("dir", "module").orderBy("rank", "package", "target")
    return met.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("dir", "module", "target")


def import_ways(imports: DataFrame) -> DataFrame:
    """(path, dir, module, kind, name, local, line_no, scope): what each import may bring in, and from which module.

    ``kind`` is ``name`` (one name of the module), ``star`` (all of them) or ``module`` (the module itself); ``local`` is
    what the importing file calls it, bound in ``scope``.
    """
    each = imports.select(
        "path", "module", "scope", F.inline(F.arrays_zip("names", "aliases", "name_lines"))
    ).withColumnsRenamed({"names": "name", "aliases": "alias", "name_lines": "line_no"})

    def way(kind: str, module: Column, local: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), module.alias("module"), local.alias("local"))

    name, module, called = F.col("name"), F.col("module"), F.coalesce("alias", "name")
    # ``import a.b`` loads a and a.b, and binds a. ``from a import b`` may also mean the module a/b.py.
    parts = F.split(name, "\\.")
    loaded = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: way("module", F.array_join(F.slice(parts, F.lit(1), n), "."), F.get(parts, F.lit(0))),
    )
    dotted = F.when(module.endswith("."), F.concat(module, name)).otherwise(F.concat_ws(".", module, name))
    ways = (
        F.when(module.isNull() & F.col("alias").isNull(), loaded)
        .when(module.isNull(), F.array(way("module", name, called)))
        .when(name == "*", F.array(way("star", module, name)))
        .otherwise(F.array(way("name", module, called), way("module", dotted, called)))
    )
    directory = F.regexp_replace("path", "[^/]*$", "")
    return each.select("path", directory.alias("dir"), "name", "line_no", "scope", F.inline(ways)).select(
        "path", "dir", "module", "kind", "name", "local", "line_no", "scope"
    )


def import_edges(imports: DataFrame, places: DataFrame) -> DataFrame:
    """(path, target, kind, name, local, line_no, scope): ``import_ways`` with the file of the corpus that each leads to."""
    ways = import_ways(imports)
    targets = stored(resolve_modules(stored(ways.select("dir", "module").distinct()), places))
    return list_join(ways, targets, ["dir", "module"]).select(
        "path", "target", "kind", "name", "local", "line_no", "scope"
    )


def _following(holders: DataFrame, edges: DataFrame) -> DataFrame:
    """Holders that come from imports of ``holders``, with ``line_no`` where the import itself names the symbol.

    Only what a module binds itself can be imported from it. An import of one name meets the symbols under that name,
    other imports those of the whole module.
    """
    given = holders.where(F.col("scope") == MODULE).withColumnsRenamed({"path": "target", "scope": "_", "base": "__"}).drop("_", "__")
    small = fits_broadcast(given)
    by_name = list_join(
        edges.where(F.col("kind") == "name"), given.withColumn("name", F.col("exported")), ["target", "name"], small
    )
    by_module = list_join(edges.where(F.col("kind") != "name"), given, ["target"], small).where(
        (F.col("kind") == "module") | ~F.col("exported").startswith("_")
    )
    plain, kind = F.col("plain"), F.col("kind")
    return by_name.unionByName(by_module).select(
        "symbol", "def_path", "path",
        F.when(kind == "star", F.col("exported")).otherwise(F.col("local")).alias("exported"),
        F.when(plain & (kind == "name"), F.col("local")).when(plain & (kind == "module"), F.col("exported")).otherwise(
            F.col("used")).alias("used"),
        (plain & (kind != "module")).alias("plain"),
        (~plain | (kind == "module")).alias("dotted"),
        F.when(plain & (kind == "module"), F.col("local")).otherwise("").alias("base"),
        F.when(kind == "star", F.lit(MODULE)).otherwise(F.col("scope")).alias("scope"),
        F.when(plain & (kind == "name"), F.col("line_no")).alias("line_no"),
    )


class _Facts:
    """Imports and uses of the Python files that may matter; files are parsed when a name they hold is first looked for."""

    def __init__(self, python_files: DataFrame):
        self.files = python_files.select("path", "text")
        self.places = module_places(python_files)
        self.seen: Column | None = None  # tells which files are parsed already
        self.everything = False
        self.uses: list[DataFrame] = []
        self.edges: list[DataFrame] = []

    def look_for(self, names: DataFrame) -> bool:
        """Parse files that hold one of ``names``, all names of a module, or a package, so far as that is not done. False
        when there are no names."""
        few = [r[0] for r in names.distinct().limit(joins.INLINE_NAMES + 1).collect()]
        if not few or self.everything:
            return bool(few)
        if len(few) > joins.INLINE_NAMES:
            matching, self.everything = F.lit(True), True
        else:
            matching = F.arrays_overlap(words(F.col("text")), F.array(*map(F.lit, few)))
            if self.seen is None:
                matching |= F.col("text").rlike(r"import\s*\(?\s*\*") | F.col("path").endswith("__init__.py")
        chosen = self.files.where(matching if self.seen is None else matching & ~F.coalesce(self.seen, F.lit(False)))
        self.seen = matching if self.seen is None else self.seen | matching
        part = stored(parse_python(chosen, signatures=False, uses=True).select("path", "parsed.imports", "parsed.uses"))
        self.uses.append(part.select("path", F.inline("uses")))
        self.edges.append(stored(import_edges(part.select("path", F.inline("imports")), self.places)))
        return True


def _holders(facts: _Facts, first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All holders, and those import lines that name the symbol.

    Imports are led to their files once, when their file is parsed. A round then meets the newest holders with the
    imports that were known before, and all holders with those of files that have only now been parsed.
    """
    known, frontier, lines, old = first, first, [], 0
    while facts.look_for(frontier.select(F.explode(F.array("exported", "used")))):
        met = [_following(known, part) for part in facts.edges[old:]] + [_following(frontier, part) for part in facts.edges[:old]]
        old = len(facts.edges)
        found = stored(reduce(DataFrame.unionByName, met).distinct())
        lines.append(found.where("line_no IS NOT NULL").select("symbol", "def_path", "path", "line_no"))
        frontier = stored(found.select(_HOLDER).distinct().join(known, _HOLDER, "left_anti"))
        known = known.unionByName(frontier)
    named = reduce(DataFrame.unionByName, lines) if lines else None
    return known, named


def resolved_references(files: DataFrame, requests: DataFrame) -> DataFrame:
    """(req_id, symbol, path, line_no, method, status, message) for ``requests(req_id, symbol, path)``.

    A symbol defined in the given ``.py`` file is followed through the imports of Python files, under the names they give
    it: method ``resolved``. Lines are those of names, attributes and imports in the syntax tree, so comments and strings
    do not count. A name counts where it means that binding: parameters, locals, loop variables of comprehensions and
    class attributes of the same name do not, and an import inside a function counts in there alone. An attribute of a
    module counts unless the name in front of it is shadowed; a method or nested symbol counts wherever an attribute of
    its name stands in a file that has the class around it. Any other request is a word search over the whole corpus: method ``text``. A request without a hit is one
    row with status ``no_references``.

    Files are searched for the names first, and only those that hold one are parsed, along with packages and files that
    import all names of a module. Equal rows of ``requests`` give equal answers; a null symbol is never found.
    """
    # Everything located below is at most one row per request, so one measure of the requests holds for all of it.
    small = fits_broadcast(requests.select("req_id", "symbol", "path"))
    asked = requests.select("symbol", F.col("path").alias("def_path")).distinct()
    python_files = files.where(F.col("kind") == "python")

    # Where the definitions are: only the files that requests name are parsed for it.
    located = stored(
        symbols_table(
            parse_python(
                restrict_to_paths(python_files, requests.select("path").distinct(), small), signatures=False, uses=True
            )
        )
        .where("first_named")
        .select(
            F.col("path").alias("def_path"), F.col("name").alias("symbol"), F.col("start_line").alias("line_no"), "top_name",
            "scope",
        )
        .join(asked, ["def_path", "symbol"])
    )
    top = F.col("symbol") == F.col("top_name")
    first = located.select(
        "symbol", "def_path", F.col("def_path").alias("path"), F.col("top_name").alias("exported"),
        F.col("symbol").alias("used"), top.alias("plain"), (~top).alias("dotted"), F.lit("").alias("base"),
        F.lit(MODULE).alias("scope"),
    )
    facts = _Facts(python_files)
    holders, named = _holders(facts, first)

    hits = located.select("symbol", "def_path", F.col("def_path").alias("path"), "line_no")
    if named is not None:
        ways = holders.select("symbol", "def_path", "path", F.col("used").alias("name"), "dotted", "base", "scope").unionByName(
            # In its own file a symbol goes by its bare name, where it is bound, and as an attribute alike.
            located.select(
                "symbol", "def_path", F.col("def_path").alias("path"), F.col("symbol").alias("name"), top.alias("dotted"),
                F.lit("").alias("base"), F.when(top, F.lit(MODULE)).otherwise(F.col("scope")).alias("scope"),
            )
        ).distinct().withColumnsRenamed({"base": "way_base", "scope": "way_scope"})
        uses = reduce(DataFrame.unionByName, facts.uses)
        met = file_join(uses, ways, ["path", "name", "dotted"], fits_broadcast(ways))
        same = F.col("scope") == F.col("way_scope")
        shadowed = (F.col("way_base") != "") & F.col("base").eqNullSafe(F.col("way_base")) & ~same
        used = met.where(F.when(F.col("dotted"), ~shadowed).otherwise(same))
        columns = ["symbol", "def_path", "path", "line_no"]
        hits = hits.unionByName(named).unionByName(used.select(columns)).distinct()

    asked_by = requests.select("req_id", "symbol", F.col("path").alias("def_path"))
    hits = hits if small else stored(hits)
    by_import = list_join(hits, asked_by, ["symbol", "def_path"], small).withColumn("method", F.lit("resolved"))
    unlocated = asked_by.join(located.select("symbol", "def_path"), ["symbol", "def_path"], "left_anti")
    texts = stored(find_references_bulk(files, unlocated.select("symbol")))
    by_text = list_join(texts, unlocated, ["symbol"], small).withColumn("method", F.lit("text"))
    columns = ["req_id", "symbol", "path", "line_no", "method"]
    answered = by_import.select(columns).unionByName(by_text.select(columns)).select(
        "*", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("message")
    )
    silent = unlocated.join(texts.select("symbol").distinct(), "symbol", "left_anti")
    return answered.unionByName(
        silent.select(
            "req_id", "symbol", F.lit("text").alias("method"), F.lit("no_references").alias("status"),
            F.lit(messages.NO_REFERENCES).alias("message"),
        ),
        allowMissingColumns=True,
    )
