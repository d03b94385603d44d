"""Registered queries: every operator over whole tables, or over corpora that Spark derives from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.functions.routing import language_family
from codescope.operators import config_files, dockerfile, python_symbols, python_views, references, resolved, script_modules, script_symbols
from codescope.operators.lines import file_lines
from codescope.plans import lookup, report, views
from codescope.sources.corpus import classify_files, decode_text, prune_files

from . import corpora
from .corpora import table


# ---- sources ---------------------------------------------------------------------------------------------------


def generated_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One path per part, over many names and directories."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")

    def cycle(values: list[str], divisor: int):
        return F.element_at(F.array(*map(F.lit, values)), (F.floor(key / divisor) % len(values) + 1).cast("int"))

    dirs = cycle(["src", ".git", "node_modules/x", "a/tests", "lib/.cache", "dist", "__pycache__"], 1)
    names = cycle(
        ["m.py", "v.TSX", "Dockerfile", "dockerfile.dev", "x.dockerfile", "c.yaml", "c.JSON", ".env", "Dockerfile.py",
         "a.b.rb", "noext", "_x.svelte", "app.jsx"], 7,
    )
    return part.select(F.concat(F.lit("repo/"), dirs, F.format_string("/%d/", key), names).alias("path"))


def classified_paths(spark, sf_dir):
    files = classify_files(generated_paths(spark, sf_dir))
    return files.select("path", "ext", "kind", "language", language_family(F.col("path")).alias("family"))


def pruned_paths(spark, sf_dir):
    return prune_files(generated_paths(spark, sf_dir), "repo").select("path")


def decoded_documents(spark, sf_dir):
    """Documents as bytes, a third of them with a broken byte in front and one behind."""
    docs = table(spark, sf_dir, "documents")
    broken = F.col("doc_id") % 3 == 0
    content = F.when(broken, F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))).otherwise(
        F.encode("text", "UTF-8")
    )
    files = docs.select("doc_id", content.alias("content"))
    strict = decode_text(files, "strict").select("doc_id", "status", F.md5("text").alias("strict_md5"))
    ignoring = decode_text(files, "ignore").select(
        "doc_id", F.md5("text").alias("ignore_md5"), F.length("text").alias("n_chars")
    )
    return strict.join(ignoring, "doc_id")


def document_lines(spark, sf_dir):
    return file_lines(corpora.document_files(spark, sf_dir))


# ---- references ------------------------------------------------------------------------------------------------


def find_references_the(spark, sf_dir):
    return references.render_hits(references.find_references(corpora.document_files(spark, sf_dir), "the"))


def find_references_phrase(spark, sf_dir):
    return references.find_references(corpora.page_files(spark, sf_dir), "track(0);</script")


_WORD, _GAP = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]+"


def benchmark_symbols(spark, sf_dir):
    """Every word of every benchmark item."""
    words = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    return table(spark, sf_dir, "benchmark").select(F.explode(words).alias("symbol")).distinct()


def find_references_bulk(spark, sf_dir):
    return references.find_references_bulk(
        corpora.document_files(spark, sf_dir), benchmark_symbols(spark, sf_dir)
    )


def find_references_phrases(spark, sf_dir):
    """Names that are not plain words: all neighbouring words of one line of each benchmark item, as they are written."""
    parts = table(spark, sf_dir, "benchmark").select(
        F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("words"),
        F.regexp_extract_all("text", F.lit(_GAP), F.lit(0)).alias("gaps"),
        F.col("text").rlike(r"\A" + _GAP).cast("int").alias("shift"),
    ).where("size(words) > 1")
    pair = F.transform(
        F.sequence(F.lit(0), F.size("words") - 2),
        lambda i: F.concat(F.get("words", i), F.get("gaps", i + F.col("shift")), F.get("words", i + 1)),
    )
    symbols = parts.select(F.explode(pair).alias("symbol")).where(~F.contains("symbol", F.lit("\n"))).distinct()
    return references.find_references_bulk(corpora.document_files(spark, sf_dir), symbols)


def reference_requests(spark, sf_dir):
    """One request for each word of the benchmark, and one per item for a word that is nowhere."""
    benchmark = table(spark, sf_dir, "benchmark")
    words = benchmark.select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("at", "name"))
    first = F.min(F.col("item_id") * 100_000 + F.col("at")).alias("req_id")
    asked = words.groupBy("name").agg(first).select("req_id", "name")
    nowhere = benchmark.select((-1 - F.col("item_id")).alias("req_id"), F.format_string("nowhere_%d", "item_id").alias("name"))
    return lookup.find_references(corpora.document_files(spark, sf_dir), asked.union(nowhere))


def resolved_requests(spark, sf_dir):
    """The class of each nation, every fifth with a path that is not there, and as many names that are nowhere."""
    nation = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    home = F.format_string("lib/nation_%d.py", key)
    classes = nation.select(
        key.cast("long").alias("req_id"), F.format_string("Nation%d", key).alias("symbol"),
        F.when(key % 5 == 0, F.lit("lib/nowhere.py")).otherwise(home).alias("path"),
    )
    nowhere = nation.select((-1 - key).cast("long"), F.format_string("Nowhere%d", key), home)
    return classes.union(nowhere)


def resolved_references(spark, sf_dir):
    return resolved.resolved_references(corpora.user_files(spark, sf_dir), resolved_requests(spark, sf_dir))


def scoped_references(spark, sf_dir):
    """Uses of the class of each nation where parameters, locals, loop variables and attributes share its name."""
    key = F.col("n_nationkey")
    requests = table(spark, sf_dir, "nation").select(
        key.cast("long").alias("req_id"), F.format_string("Nation%d", key).alias("symbol"),
        F.format_string("lib/nation_%d.py", key).alias("path"))
    return resolved.resolved_references(corpora.shadowing_files(spark, sf_dir), requests)


# ---- Python ----------------------------------------------------------------------------------------------------


def _python(spark, sf_dir, signatures=False):
    return python_symbols.parse_python(corpora.python_files(spark, sf_dir), signatures)


def python_symbols_table(spark, sf_dir):
    columns = ["path", "ord", "bfs_ord", "name", "kind", "is_async", "parent", "parent_ord", "top_name", "depth",
               "listed", "start_line", "end_line", "name_col", "header", "doc_first"]
    return python_symbols.symbols_table(_python(spark, sf_dir, True)).select(columns)


def python_imports_table(spark, sf_dir):
    lists = {c: F.array_join(c, ",") for c in ("names", "aliases", "name_lines")}
    return python_symbols.imports_table(_python(spark, sf_dir)).withColumns(lists)


def python_parse_status(spark, sf_dir):
    return python_symbols.parse_status(_python(spark, sf_dir))


def python_symbol_tree(spark, sf_dir):
    return python_symbols.symbol_tree(_python(spark, sf_dir))


def python_structure(spark, sf_dir):
    return python_views.with_view(_python(spark, sf_dir), python_views.structure(F.col("parsed")))


def python_structure_labels(spark, sf_dir):
    return python_views.with_view(_python(spark, sf_dir), python_views.structure(F.col("parsed"), labels=True))


def python_skeleton(spark, sf_dir):
    return python_views.with_view(_python(spark, sf_dir, True), python_views.skeleton(F.col("parsed")))


def python_line_skeleton(spark, sf_dir):
    return python_views.with_view(_python(spark, sf_dir, True), python_views.line_skeleton(F.col("parsed")))


def python_imports_block(spark, sf_dir):
    return python_views.with_view(_python(spark, sf_dir), python_views.imports_block(F.col("parsed")))


def python_requests(spark, sf_dir):
    """One request per part, for four kinds of name, every ninth in a file that is not there."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    home = F.format_string("src/%s/part_%d.py", F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), key)
    name = (
        F.when(key % 4 == 0, F.format_string("Part%d", key))
        .when(key % 4 == 1, "m_1")
        .when(key % 4 == 2, F.format_string("build_%d", key))
        .otherwise("missing")
    )
    return part.select(
        (key * 5).alias("req_id"),
        F.when(key % 9 == 8, F.format_string("src/gone_%d.py", key)).otherwise(home).alias("path"),
        name.alias("name"),
    )


def python_symbol_body(spark, sf_dir):
    return lookup.symbol_body(corpora.python_files(spark, sf_dir), python_requests(spark, sf_dir))


def python_symbol_card(spark, sf_dir):
    return lookup.symbol_card(corpora.python_files(spark, sf_dir), python_requests(spark, sf_dir))


def python_locate_definition(spark, sf_dir):
    return lookup.locate_definition(corpora.python_files(spark, sf_dir), python_requests(spark, sf_dir))


# ---- scripts ---------------------------------------------------------------------------------------------------


def _scripts(spark, sf_dir):
    return script_symbols.scan_scripts(corpora.script_files(spark, sf_dir))


def page_script_blocks(spark, sf_dir):
    return script_symbols.script_blocks(corpora.page_files(spark, sf_dir))


def page_script_bodies(spark, sf_dir):
    """The variable ``t`` that the script of each page declares, pages being read as components."""
    scanned = script_symbols.scan_scripts(corpora.page_files(spark, sf_dir))
    return scanned.select("path", script_symbols.symbol_body(F.col("statements"), F.col("script"), F.lit("t")).alias("body"))


def script_declarations(spark, sf_dir):
    return script_symbols.script_declarations(_scripts(spark, sf_dir))


def script_structure(spark, sf_dir):
    return _scripts(spark, sf_dir).select("path", script_symbols.structure(F.col("statements")).alias("view"))


def script_skeleton(spark, sf_dir):
    return _scripts(spark, sf_dir).select("path", script_symbols.skeleton(F.col("statements")).alias("view"))


def script_structure_labels(spark, sf_dir):
    return _scripts(spark, sf_dir).select("path", script_symbols.structure(F.col("statements"), labels=True).alias("view"))


def script_line_skeleton(spark, sf_dir):
    return _scripts(spark, sf_dir).select(
        "path", script_symbols.line_skeleton(F.col("statements"), F.col("script")).alias("view")
    )


def script_imports(spark, sf_dir):
    return _scripts(spark, sf_dir).select("path", script_symbols.imports_block(F.col("statements"), F.col("script")).alias("view"))


def script_imports_table(spark, sf_dir):
    return script_modules.script_imports_table(script_symbols.scan_scripts(corpora.module_files(spark, sf_dir)))


def script_resolved_references(spark, sf_dir):
    """The class of each nation and the name its package gives it, which that package does not declare."""
    key = F.col("n_nationkey")
    nation = table(spark, sf_dir, "nation")
    classes = nation.select(
        key.cast("long").alias("req_id"), F.format_string("Nation%d", key).alias("symbol"), F.format_string("lib/n%d.ts", key).alias("path"))
    others = nation.select((-1 - key).cast("long"), F.format_string("Home%d", key), F.format_string("pack/p%d/index.ts", key))
    return script_modules.script_resolved_references(corpora.module_files(spark, sf_dir), classes.union(others))


def script_requests(spark, sf_dir):
    key = F.col("c_custkey")
    name = (
        F.when(key % 4 == 0, F.format_string("load%d", key))
        .when(key % 4 == 1, F.format_string("Customer%d", key))
        .when(key % 4 == 2, F.format_string("run%d", key))
        .otherwise("nothing")
    )
    return table(spark, sf_dir, "customer").select(
        (key * 5 + 1).alias("req_id"), F.format_string("web/c%d.ts", key).alias("path"), name.alias("name")
    )


def script_symbol_body(spark, sf_dir):
    return lookup.symbol_body(corpora.script_files(spark, sf_dir), script_requests(spark, sf_dir))


# ---- JSON and YAML ---------------------------------------------------------------------------------------------


def _json(spark, sf_dir, bodies=False):
    return config_files.parse_config(corpora.json_files(spark, sf_dir), bodies)


def _yaml(spark, sf_dir, bodies=False):
    return config_files.parse_config(corpora.yaml_files(spark, sf_dir), bodies)


def _config_view(parsed, view):
    failed = config_files.parse_failure(F.col("path"), F.col("kind"), F.col("config"))
    return parsed.select("path", F.coalesce(failed, view).alias("view"))


def event_json_entries(spark, sf_dir):
    parsed = config_files.parse_config(corpora.event_files(spark, sf_dir))
    return config_files.config_entries(parsed)


def json_entries(spark, sf_dir):
    return config_files.config_entries(_json(spark, sf_dir, True)).drop("body")


def json_roots(spark, sf_dir):
    return config_files.config_roots(_json(spark, sf_dir))


def json_structure(spark, sf_dir):
    return _config_view(_json(spark, sf_dir), config_files.structure(F.col("config")))


def json_skeleton(spark, sf_dir):
    return _config_view(_json(spark, sf_dir), config_files.skeleton(F.col("config")))


def json_ref_targets(spark, sf_dir):
    return config_files.json_ref_targets(corpora.json_files(spark, sf_dir))


def json_requests(spark, sf_dir):
    key = F.col("c_custkey")
    name = F.when(key % 4 == 0, "id").when(key % 4 == 1, "nested").when(key % 4 == 2, "name").otherwise("nope")
    return table(spark, sf_dir, "customer").select(
        (key * 5 + 2).alias("req_id"), F.format_string("conf/c%d.json", key).alias("path"), name.alias("name")
    )


def json_key_body(spark, sf_dir):
    return lookup.symbol_body(corpora.json_files(spark, sf_dir), json_requests(spark, sf_dir))


def yaml_entries(spark, sf_dir):
    return config_files.config_entries(_yaml(spark, sf_dir, True))


def yaml_structure(spark, sf_dir):
    return _config_view(_yaml(spark, sf_dir), config_files.structure(F.col("config")))


def yaml_skeleton(spark, sf_dir):
    return _config_view(_yaml(spark, sf_dir), config_files.skeleton(F.col("config")))


def yaml_requests(spark, sf_dir):
    key = F.col("s_suppkey")
    name = F.when(key % 4 == 0, "list").when(key % 4 == 1, "map").when(key % 4 == 2, "id").otherwise("nope")
    return table(spark, sf_dir, "supplier").select(
        (key * 5 + 3).alias("req_id"), F.format_string("conf/s%d.yml", key).alias("path"), name.alias("name")
    )


def yaml_key_body(spark, sf_dir):
    return lookup.symbol_body(corpora.yaml_files(spark, sf_dir), yaml_requests(spark, sf_dir))


def yaml_anchors_includes(spark, sf_dir):
    """Anchors and includes of the generated files, and the entities of all pages, which read as anchors."""
    generated = config_files.yaml_anchors_includes(corpora.yaml_files(spark, sf_dir))
    return generated.unionByName(config_files.yaml_anchors_includes(corpora.page_files(spark, sf_dir, "yml")))


def page_yaml_imports(spark, sf_dir):
    pages = corpora.page_files(spark, sf_dir, "yml")
    return pages.select("path", config_files.yaml_imports(F.col("text")).alias("view"))


# ---- Dockerfiles -----------------------------------------------------------------------------------------------


def _docker(spark, sf_dir):
    return dockerfile.with_instructions(corpora.docker_files(spark, sf_dir))


def docker_instructions(spark, sf_dir):
    return dockerfile.docker_instructions(corpora.docker_files(spark, sf_dir))


def docker_stages(spark, sf_dir):
    return dockerfile.docker_stages(corpora.docker_files(spark, sf_dir))


def docker_structure(spark, sf_dir):
    return _docker(spark, sf_dir).select("path", dockerfile.structure(F.col("instr")).alias("view"))


def docker_skeleton(spark, sf_dir):
    return _docker(spark, sf_dir).select("path", dockerfile.skeleton(F.col("instr")).alias("view"))


def docker_base_images(spark, sf_dir):
    return _docker(spark, sf_dir).select("path", dockerfile.base_images(F.col("instr")).alias("view"))


def docker_requests(spark, sf_dir):
    key = F.col("o_orderkey")
    name = F.when(key % 4 == 0, "env").when(key % 4 == 1, "first").when(key % 4 == 2, "second").otherwise("nope")
    return table(spark, sf_dir, "orders").select(
        (key * 5 + 4).alias("req_id"), corpora.docker_path(key).alias("path"), name.alias("name")
    )


def docker_body(spark, sf_dir):
    return lookup.symbol_body(corpora.docker_files(spark, sf_dir), docker_requests(spark, sf_dir))


# ---- all kinds -------------------------------------------------------------------------------------------------


def mixed_structure(spark, sf_dir):
    return views.structure(corpora.mixed_files(spark, sf_dir))


def mixed_skeleton(spark, sf_dir):
    return views.skeleton(corpora.mixed_files(spark, sf_dir))


def mixed_imports(spark, sf_dir):
    return views.imports(corpora.mixed_files(spark, sf_dir))


def batch_lookup_bodies(spark, sf_dir):
    makers = (python_requests, script_requests, json_requests, yaml_requests, docker_requests)
    requests = reduce(DataFrame.unionByName, [make(spark, sf_dir) for make in makers])
    return lookup.batch_lookup(corpora.mixed_files(spark, sf_dir), requests, "symbol_body")


def batch_lookup_structure(spark, sf_dir):
    requests = python_requests(spark, sf_dir).drop("name")
    return lookup.batch_lookup(corpora.mixed_files(spark, sf_dir), requests, "structure")


def batch_lookup_references(spark, sf_dir):
    requests = resolved_requests(spark, sf_dir).withColumnRenamed("symbol", "name")
    return lookup.batch_lookup(corpora.user_files(spark, sf_dir), requests, "references")


def batch_lookup_resolved(spark, sf_dir):
    requests = resolved_requests(spark, sf_dir).withColumnRenamed("symbol", "name")
    return lookup.batch_lookup(corpora.user_files(spark, sf_dir), requests, "resolved_references")


def anywhere_requests(spark, sf_dir):
    """Names of all kinds whose file is not known, one per part, customer and supplier; every sixth part names its file."""
    k = F.col("p_partkey").cast("long")
    way, home = k % 6, F.format_string("src/%s/part_%d.py", F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), k)
    parts = table(spark, sf_dir, "part").select(
        (k * 3).alias("req_id"), F.when(way == 5, home).alias("path"),
        F.when(way.isin(0, 5), F.format_string("Part%d", k))
        .when(way == 1, F.format_string("m_%d", k % 8 + 1))
        .when(way == 2, F.format_string("build_%d", k))
        .when(way == 3, F.format_string("inner_%d", k))
        .otherwise(F.format_string("nowhere_%d", k)).alias("name"),
    )

    def others(name, key, rest, names):
        k = F.col(key).cast("long")
        chosen = F.element_at(F.array(*names), (k % len(names) + 1).cast("int"))
        return table(spark, sf_dir, name).select(
            (k * 3 + rest).alias("req_id"), F.lit(None).cast("string").alias("path"), chosen.alias("name"))

    scripts = [*(F.format_string(f"{word}%d", "c_custkey") for word in ("load", "Customer", "run")), F.lit("nested")]
    customers = others("customer", "c_custkey", 1, scripts)
    suppliers = others("supplier", "s_suppkey", 2, [F.lit(n) for n in ("list", "map", "env", "first")])
    return parts.unionByName(customers).unionByName(suppliers)


def batch_lookup_bodies_anywhere(spark, sf_dir):
    return lookup.batch_lookup(corpora.mixed_files(spark, sf_dir), anywhere_requests(spark, sf_dir), "symbol_body")


def batch_lookup_cards_anywhere(spark, sf_dir):
    return lookup.batch_lookup(corpora.mixed_files(spark, sf_dir), anywhere_requests(spark, sf_dir), "symbol_card")


def batch_lookup_locations_anywhere(spark, sf_dir):
    return lookup.batch_lookup(corpora.mixed_files(spark, sf_dir), anywhere_requests(spark, sf_dir), "locate")



def view_cost_report(spark, sf_dir):
    return report.view_cost_report(corpora.mixed_files(spark, sf_dir))


def view_size_distribution(spark, sf_dir):
    return report.view_size_distribution(corpora.mixed_files(spark, sf_dir))


QUERIES = {
    query.__name__: query
    for query in (
        classified_paths, pruned_paths, decoded_documents, document_lines,
        find_references_the, find_references_phrase, find_references_bulk, find_references_phrases,
        reference_requests, resolved_references, scoped_references,
        python_symbols_table, python_imports_table, python_parse_status, python_symbol_tree, python_structure,
        python_structure_labels, python_skeleton, python_line_skeleton, python_imports_block, python_symbol_body,
        python_symbol_card, python_locate_definition,
        page_script_blocks, page_script_bodies, script_declarations, script_structure, script_structure_labels,
        script_skeleton, script_line_skeleton,
        script_imports, script_imports_table, script_resolved_references, script_symbol_body,
        event_json_entries, json_entries, json_roots, json_structure, json_skeleton, json_ref_targets, json_key_body,
        yaml_entries, yaml_structure, yaml_skeleton, yaml_key_body, yaml_anchors_includes, page_yaml_imports,
        docker_instructions, docker_stages, docker_structure, docker_skeleton, docker_base_images, docker_body,
        mixed_structure, mixed_skeleton, mixed_imports, batch_lookup_bodies, batch_lookup_structure,
        batch_lookup_references, batch_lookup_resolved, batch_lookup_bodies_anywhere, batch_lookup_cards_anywhere,
        batch_lookup_locations_anywhere, view_cost_report, view_size_distribution,
    )
}
