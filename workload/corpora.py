"""File corpora made from the given tables by Spark projections: one file per row, so nothing is grouped or shuffled.

The tables hold no source code. These texts are built so that what the operators must find in them can be computed
from the tables directly.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.sources.corpus import classify_files, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _repeat(count: Column, template: str, *values) -> Column:
    """``template`` once for each i in 1..count, joined; ``values`` map i to the format arguments."""
    parts = F.transform(
        F.sequence(F.lit(1), count), lambda i: F.format_string(template, *[v(i) if callable(v) else v for v in values])
    )
    return F.array_join(parts, "")


def _filled(template: str, *values: Column) -> Column:
    """What ``format_string`` gives for ``%d`` and ``%s`` of whole numbers and texts."""
    pieces = re.split("%[ds]", template)
    shown = [F.coalesce(v.cast("string"), F.lit("null")) for v in values]
    return F.concat(F.lit(pieces[0]), *[part for v, p in zip(shown, pieces[1:], strict=True) for part in (v, F.lit(p))])


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(F.format_string("docs/%d.txt", "doc_id").alias("path"), "text")


def page_files(spark: SparkSession, sf_dir: str, suffix: str = "svelte") -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages"))
    return classify_files(
        pages.select(F.format_string(f"pages/%d.{suffix}", "page_id").alias("path"), F.col("html").alias("text"))
    )


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spread(table(spark, sf_dir, "events"))
    return classify_files(
        events.select(F.format_string("events/%d.json", "event_id").alias("path"), F.col("props").alias("text"))
    )


PY_HEAD = '''import os
from pathlib import (
    Path,
)


class Part%d(Base, Sized):
    """%s"""

'''
PY_METHOD = '''    def m_%d(self, size: int = %d) -> float:
        """%s %d"""
        return size * %d

'''
PY_TAIL = '''
async def build_%d(n: int=%d):
    """Build %s

    At length.
    """
    def inner_%d(): pass
    return n
'''


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One module per part with a class of ``p_size % 8 + 1`` methods; every fiftieth one does not parse."""
    part = spread(table(spark, sf_dir, "part"))
    key, size = F.col("p_partkey"), F.col("p_size")
    text = F.concat(
        F.format_string(PY_HEAD, key, "p_name"),
        _repeat(size % 8 + 1, PY_METHOD, lambda i: i, size, F.col("p_type"), lambda i: i, lambda i: i),
        F.format_string(PY_TAIL, key, size, "p_name", key),
    )
    return classify_files(
        part.select(
            F.format_string("src/%s/part_%d.py", F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), key).alias(
                "path"
            ),
            F.when(key % 50 == 7, F.lit("class (nothing:\n")).otherwise(text).alias("text"),
        )
    )


DOCKER_STAGE = '''FROM base:%d%s
ENV K%d=%d
run make \\
  all
EXPOSE 80%d

'''


def docker_path(key: Column) -> Column:
    return _filled("img/%d/Dockerfile", key)


def docker_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Dockerfile per order with ``o_orderkey % 3 + 1`` stages: named with AS, with as, and not named."""
    orders = spread(table(spark, sf_dir, "orders"))
    key, tag = F.col("o_orderkey"), F.col("o_custkey") % 10

    def alias(i: Column) -> Column:
        return F.when(i == 1, " AS first").when(i == 2, " as second").otherwise("")

    text = F.concat(
        F.format_string("# order %d\nARG V=%d\n\n", key, "o_custkey"),
        _repeat((key % 3 + 1).cast("int"), DOCKER_STAGE, tag, alias, lambda i: i, key, lambda i: i),
        F.format_string('cmd   ["%s"]\n', "o_orderpriority"),
    )
    # The same text for the usual keys, without a formatter and a lambda for each row.
    names = (" AS first", " as second", "")
    built = [
        _filled(DOCKER_STAGE, tag, F.lit(name), F.lit(str(i)), key, F.lit(str(i))) for i, name in enumerate(names, start=1)
    ]
    plain = F.concat(
        _filled("# order %d\nARG V=%d\n\n", key, F.col("o_custkey")), built[0],
        *[F.when(key % 3 >= i, built[i]).otherwise("") for i in (1, 2)], _filled('cmd   ["%s"]\n', F.col("o_orderpriority")),
    )
    return classify_files(orders.select(docker_path(key).alias("path"), F.when(key >= 0, plain).otherwise(text).alias("text")))


JSON_TEXT = '''{
  "id": %d,
  "name": "%s",
  "long": "%s",
  "active": %s,
  "note": null,
  "list": [%s],
  "nested": {"z": {"$ref": "#/defs/%d"}, "a": [1, {"b": "\u00e9"}]},
  "link": {"$ref" : "other.json#/%s"},
  "id": %d
}
'''


def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object per customer, with a repeated key, nested values and references; every fortieth does not parse."""
    customer = spread(table(spark, sf_dir, "customer"))
    key = F.col("c_custkey")
    text = F.format_string(
        JSON_TEXT, key, "c_name", F.repeat("c_name", 6), F.when(key % 2 == 0, "true").otherwise("false"),
        F.array_join(F.sequence(F.lit(1), (key % 4 + 1).cast("int")), ", "), "c_nationkey", "c_mktsegment", key + 1,
    )
    return classify_files(
        customer.select(
            F.format_string("conf/c%d.json", key).alias("path"),
            F.when(key % 40 == 3, F.lit("{'id': 1}")).when(key % 40 == 4, F.lit("[1, 2, 3]")).otherwise(text).alias(
                "text"
            ),
        )
    )


YAML_TEXT = '''# !include common/%d.yml
id: &id%d %d
name: %s
on: yes
empty:
list: [%s]
map:
  b: *id%d
  a: text
'''


def yaml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mapping per supplier with an anchor and an include; every fortieth is a list."""
    supplier = spread(table(spark, sf_dir, "supplier"))
    key = F.col("s_suppkey")
    text = F.format_string(
        YAML_TEXT, "s_nationkey", key, key, "s_name",
        F.array_join(F.sequence(F.lit(1), (key % 4 + 1).cast("int")), ", "), key,
    )
    return classify_files(
        supplier.select(
            F.format_string("conf/s%d.yml", key).alias("path"),
            F.when(key % 40 == 4, F.lit("- 1\n- 2\n")).otherwise(text).alias("text"),
        )
    )


SCRIPT_HEAD = '''import { Base } from "./base";
import type { Row } from './rows'
const fs = require("fs");

export interface Shape%d {
  size: number;
  name?: string
  area(x: number): number;
}

export type Alias%d = string | { a: number };

/** %s
 * more text */
export class Customer%d extends Base<{ x: 1 }> {
  private kind = "}";
  /** Makes it. */
  constructor(private id: number) {
    super(id);
  }
'''
SCRIPT_METHOD = '''  /** Step %d. */
  async step%d(n: number = %d): Promise<Row[]> {
    // not a brace: }
    if (n) /[{`]/.exec(`${n ? `{${n}` : "`"}`);
  }
'''
SCRIPT_TAIL = '''}

/** Loads it. */
export async function load%d(id: string): Promise<void> {
  if (id) { return; }
}

export const run%d = async (x: number) => {
  await load%d(`${x}`);
}
let plain%d = %d
'''


def script_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One TypeScript module per customer with a class of ``c_nationkey % 4 + 1`` methods."""
    customer = spread(table(spark, sf_dir, "customer"))
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    text = F.concat(
        F.format_string(SCRIPT_HEAD, key, key, "c_name", key),
        _repeat(nation % 4 + 1, SCRIPT_METHOD, lambda i: i, lambda i: i, nation),
        F.format_string(SCRIPT_TAIL, key, key, key, key, nation),
    )
    return classify_files(customer.select(F.format_string("web/c%d.ts", key).alias("path"), text.alias("text")))


def user_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library module and a package that renames its class per nation, and per customer a module with one of eight ways
    to use or merely mention the class."""
    nation = table(spark, sf_dir, "nation")
    customer = spread(table(spark, sf_dir, "customer"))
    key = F.col("n_nationkey")
    library = nation.select(
        F.format_string("lib/nation_%d.py", key).alias("path"),
        F.format_string("class Nation%d:\n    pass\n\nother = 1\n", key).alias("text"),
    )
    packages = nation.select(
        F.format_string("lib/pack_%d/__init__.py", key).alias("path"),
        F.format_string("from ..nation_%d import Nation%d as Home%d\n", key, key, key).alias("text"),
    )
    n, way = F.col("c_nationkey"), F.col("c_custkey") % 8
    users = customer.select(
        F.format_string("app/c%d.py", "c_custkey").alias("path"),
        F.when(way == 0, F.format_string("from nation_%d import Nation%d\n\nx = Nation%d()\n", n, n, n))
        .when(way == 1, F.format_string("import nation_%d\n\ny = nation_%d.Nation%d\n", n, n, n))
        .when(way == 2, F.format_string("# Nation%d is not imported\n", n))
        .when(way == 3, F.format_string("from nation_%d import other\n# Nation%d\n", n, n))
        .when(way == 4, F.format_string("from nation_%d import Nation%d as N\n\nx = N()\n", n, n))
        .when(way == 5, F.format_string("from pack_%d import Home%d\n\nx = Home%d()\n", n, n, n))
        .when(way == 6, F.format_string("from pack_%d import *\n\nx = Home%d()\n", n, n))
        .otherwise(F.format_string("from nation_%d import Nation%d as N\nx = 'Nation%d'\n", n, n, n))
        .alias("text"),
    )
    return classify_files(library.unionByName(packages).unionByName(users))


SHADOWED = (
    "from nation_{n} import Nation{n}\n\ndef f(Nation{n}):\n    return Nation{n}\n\nx = Nation{n}()\n",
    "def g():\n    from nation_{n} import Nation{n}\n    return Nation{n}()\n\ny = Nation{n}\n",
    "from nation_{n} import Nation{n}\n\ndef h():\n    global Nation{n}\n    return [Nation{n} for i in range(3)]\n",
    "from nation_{n} import Nation{n}\nz = [Nation{n} for Nation{n} in range(3)]\n",
    "from nation_{n} import Nation{n}\n\nclass C:\n    Nation{n} = 1\n    def m(self): return Nation{n}\n",
    "import nation_{n} as m\n\ndef f(m):\n    return m.Nation{n}\n\nw = m.Nation{n}\n",
    "from nation_{n} import Nation{n} as N\n\ndef f():\n    N = 1\n    def g():\n        return N\n    return lambda N: N\n\nv = lambda: N\n",
)


def shadowing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library module per nation, and per customer a module in which its class and something else have one name."""
    nation = table(spark, sf_dir, "nation")
    customer = spread(table(spark, sf_dir, "customer"))
    key, n = F.col("n_nationkey"), F.col("c_nationkey")
    library = nation.select(
        F.format_string("lib/nation_%d.py", key).alias("path"),
        F.format_string("class Nation%d:\n    pass\n\ndef own(Nation%d): return Nation%d\n", key, key, key).alias("text"),
    )
    forms = F.array(*[F.replace(F.lit(form), F.lit("{n}"), n.cast("string")) for form in SHADOWED])
    users = customer.select(
        F.format_string("app/c%d.py", "c_custkey").alias("path"),
        F.element_at(forms, (F.col("c_custkey") % len(SHADOWED) + 1).cast("int")).alias("text"),
    )
    return classify_files(library.unionByName(users))


IMPORTING = (
    'import { Nation{n} } from "../lib/n{n}";\nconst a = new Nation{n}(); // Nation{n}\n',
    "import { Nation{n} as N } from '../lib/n{n}';\n\nlet b = N.x;\n",
    'import * as lib from "../lib/n{n}";\nlib.Nation{n};\nlet s = "Nation{n}";\n',
    'import { Home{n} } from "../pack/p{n}";\nHome{n};\n',
    "// Nation{n}\nconst Nation{n} = 1;\n",
    'import {\n  Nation{n},\n} from "../pack/p{n}/index";\nfoo(Nation{n},\n  Nation{n});\n',
    'const { Nation{n}: Q } = require("../lib/n{n}");\nQ();\n',
    'import make, { Nation{n} } from "../far";\nmake(Nation{n});\n',
)


def module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation a module with a class and a package that re-exports it, per customer a module that imports the class
    in one of eight ways, one of which leads nowhere."""
    nation = table(spark, sf_dir, "nation")
    customer = spread(table(spark, sf_dir, "customer"))
    key, n = F.col("n_nationkey"), F.col("c_nationkey")
    library = nation.select(
        F.format_string("lib/n%d.ts", key).alias("path"),
        F.format_string("export class Nation%d {}\nexport default function make() { return new Nation%d(); }\n", key, key).alias("text"),
    )
    packages = nation.select(
        F.format_string("pack/p%d/index.ts", key).alias("path"),
        F.format_string('export * from "../../lib/n%d";\nexport { Nation%d as Home%d } from "../../lib/n%d.js";\n', key, key, key, key)
        .alias("text"),
    )
    forms = F.array(*[F.replace(F.lit(form), F.lit("{n}"), n.cast("string")) for form in IMPORTING])
    users = customer.select(
        F.format_string("app/c%d.ts", "c_custkey").alias("path"),
        F.element_at(forms, (F.col("c_custkey") % len(IMPORTING) + 1).cast("int")).alias("text"),
    )
    return classify_files(library.unionByName(packages).unionByName(users))


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds together, with a file of no supported kind per nation."""
    nation = table(spark, sf_dir, "nation")
    other = classify_files(
        nation.select(F.format_string("bin/n%d.rb", "n_nationkey").alias("path"), F.lit("puts 1\n").alias("text"))
    )
    makers = (python_files, script_files, json_files, yaml_files, docker_files)
    return reduce(DataFrame.unionByName, [make(spark, sf_dir) for make in makers], other)
