"""For every query, SQL that computes the expected rows straight from the tables, without reading any built text."""

from __future__ import annotations

WORD, NOT_WORD = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"


def _joined(count: str, item: str) -> str:
    """Newline-joined ``item`` for i in 1..count."""
    return f"array_to_string(list_transform(range(1, {count} + 1), lambda i: {item}), chr(10))"


def _lines_of(source: str, path: str, text: str) -> str:
    return f"""SELECT path, CAST(line_no AS INTEGER) AS line_no, line FROM (
        SELECT path, unnest(l) AS line, generate_subscripts(l, 1) AS line_no, len(l) AS n
        FROM (SELECT {path} AS path, string_split({text}, chr(10)) AS l FROM {source}))
      WHERE NOT (line_no = n AND line = '')"""


DOC_LINES = _lines_of("documents", "'docs/' || doc_id || '.txt'", "text")
PAGE_LINES = _lines_of("pages", "'pages/' || page_id || '.svelte'", "html")

# ---- one CTE per kind: path, status, whole text and every view ------------------------------------------------------

PYTHON = f"""
p AS (
  SELECT p_partkey AS k, p_name AS nm, p_type AS ty, p_size AS sz, p_size % 8 + 1 AS n, p_partkey % 50 = 7 AS bad,
         'src/' || replace(lower(p_brand), '#', '_') || '/part_' || p_partkey || '.py' AS path
  FROM part),
pv AS (
  SELECT *,
    E'def m_' AS d,
    {_joined("n", "'    def m_' || i || '(self, size: int = ' || sz || E') -> float:\n        \"\"\"' || ty || ' ' || i || E'\"\"\"\n        return size * ' || i || chr(10)")} AS methods,
    'async def build_' || k || '(n: int=' || sz || E'):\n    \"\"\"Build ' || nm || E'\n\n    At length.\n    \"\"\"\n    def inner_' || k || E'(): pass\n    return n' AS build_body
  FROM p WHERE NOT bad),
pw AS (
  SELECT *, 'class Part' || k || E'(Base, Sized):\n    \"\"\"' || nm || E'\"\"\"\n\n' || methods AS class_text FROM pv),
python_ok AS (
  SELECT k, path, n, nm, ty, sz, rtrim(class_text, chr(10)) AS class_body, build_body,
    E'import os\nfrom pathlib import (\n    Path,\n)\n\n\n' || class_text || E'\n\n' || build_body || chr(10) AS text,
    'Part' || k || chr(10) || {_joined("n", "'  m_' || i")} || chr(10) || 'build_' || k AS structure,
    '[Class] Part' || k || chr(10) || {_joined("n", "'  [Method] m_' || i")} || chr(10) || '[Function] build_' || k
      AS labelled,
    'class Part' || k || E'(Base, Sized):\n    \"\"\"' || nm || E'\"\"\"\n' ||
      {_joined("n", "'    def m_' || i || '(self, size: int=' || sz || E') -> float: ...\n        \"\"\"' || ty || ' ' || i || '\"\"\"'")} ||
      E'\n\nasync def build_' || k || '(n: int=' || sz || E'): ...\n    \"\"\"Build ' || nm || '\"\"\"' AS skeleton,
    'class Part' || k || E'(Base, Sized):\n    \"\"\"' || nm || E'\"\"\"\n' ||
      {_joined("n", "'    def m_' || i || '(self, size: int = ' || sz || E') -> float:\n        \"\"\"' || ty || ' ' || i || '\"\"\"'")} ||
      E'\n\nasync def build_' || k || '(n: int=' || sz || E'):\n    \"\"\"Build ' || nm || '\"\"\"' AS line_skeleton,
    E'import os\nfrom pathlib import (\n    Path,\n)' AS imports
  FROM pw),
python_bad AS (
  SELECT k, path, 'Parse error in ' || path || ': invalid syntax (<unknown>, line 1)' AS message FROM p WHERE bad)"""

SCRIPT = f"""
s AS (
  SELECT c_custkey AS k, c_name AS nm, c_nationkey AS nat, c_nationkey % 4 + 1 AS n,
         'web/c' || c_custkey || '.ts' AS path FROM customer),
sv AS (
  SELECT *,
    'export class Customer' || k || E' extends Base<{{ x: 1 }}> {{\n  private kind = "}}";\n  /** Makes it. */\n  constructor(private id: number) {{\n    super(id);\n  }}\n' ||
    {_joined("n", "'  /** Step ' || i || E'. */\n  async step' || i || '(n: number = ' || nat || E'): Promise<Row[]> {\n    // not a brace: }\n    if (n) /[{`]/.exec(`${n ? `{${n}` : \"`\"}`);\n  }'")} || E'\n}}' AS class_body,
    'export async function load' || k || E'(id: string): Promise<void> {{\n  if (id) {{ return; }}\n}}' AS load_body,
    'export const run' || k || E' = async (x: number) => {{\n  await load' || k || E'(`${{x}}`);\n}}' AS run_body,
    E'import {{ Base }} from "./base";\nimport type {{ Row }} from ''./rows''\nconst fs = require("fs");' AS imports
  FROM s),
script_ok AS (
  SELECT *,
    imports || E'\n\nexport interface Shape' || k || E' {{\n  size: number;\n  name?: string\n  area(x: number): number;\n}}\n\nexport type Alias' || k ||
      E' = string | {{ a: number }};\n\n/** ' || nm || E'\n * more text */\n' || class_body || E'\n\n/** Loads it. */\n' || load_body ||
      E'\n\n' || run_body || E'\nlet plain' || k || ' = ' || nat || chr(10) AS text,
    'Shape' || k || E'\nAlias' || k || E'\nCustomer' || k || E'\n  constructor\n' || {_joined("n", "'  step' || i")} ||
      E'\n  kind\nload' || k || E'\nrun' || k AS structure,
    '[Interface] Shape' || k || E'\nAlias' || k || E'\n[Class] Customer' || k || E'\n  [Constructor] constructor\n' ||
      {_joined("n", "'  [Method] step' || i")} || E'\n[Function] load' || k || E'\nrun' || k AS labelled,
    'export interface Shape' || k || E' {{\n\nexport type Alias' || k || E' = string | {{ a: number }};\n\nexport class Customer' ||
      k || E' extends Base<{{ x: 1 }}> {{\n  constructor(private id: number) {{\n' ||
      {_joined("n", "'  async step' || i || '(n: number = ' || nat || '): Promise<Row[]> {'")} ||
      E'\n  private kind = "}}";\n\nexport async function load' || k || '(id: string): Promise<void> {{' AS line_skeleton,
    'interface Shape' || k || E' {{\n  size: number\n  name: string\n}}\n\nclass Customer' || k || E' {{\n  /** ' || nm ||
      E' */\n  constructor(private id: number)\n' ||
      {_joined("n", "'  async step' || i || '(n: number = ' || nat || E'): Promise<Row[]>\n    /** Step ' || i || '. */'")} ||
      E'\n}}\n\nasync function load' || k || E'(id: string): Promise<void>\n  /** Loads it. */' AS skeleton
  FROM sv)"""

JSON = f"""
j AS (
  SELECT c_custkey AS k, c_name AS nm, c_nationkey AS nat, c_mktsegment AS seg, c_custkey % 4 + 1 AS n,
         'conf/c' || c_custkey || '.json' AS path, c_custkey % 40 = 3 AS bad, c_custkey % 40 = 4 AS list FROM customer),
jv AS (
  SELECT *,
    array_to_string(range(1, n + 1), ', ') AS items,
    CASE WHEN length(nm) * 6 + 2 > 80 THEN substr('''' || repeat(nm, 6) || '''', 1, 80) || '…'
         ELSE '''' || repeat(nm, 6) || '''' END AS long_preview
  FROM j),
json_files AS (
  SELECT *,
    'JSON parse error in ' || path || ': Expecting property name enclosed in double quotes: line 1 column 2 (char 1)'
      AS message,
    CASE WHEN bad THEN '{{''id'': 1}}' WHEN list THEN '[1, 2, 3]' ELSE
      E'{{\n  "id": ' || k || E',\n  "name": "' || nm || E'",\n  "long": "' || repeat(nm, 6) || E'",\n  "active": ' ||
      CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || E',\n  "note": null,\n  "list": [' || items ||
      E'],\n  "nested": {{"z": {{"$ref": "#/defs/' || nat || E'"}}, "a": [1, {{"b": "é"}}]}},\n  "link": {{"$ref" : "other.json#/' ||
      seg || E'"}},\n  "id": ' || (k + 1) || E'\n}}\n' END AS text,
    CASE WHEN list THEN '(array of 3 items)' ELSE E'id\nname\nlong\nactive\nnote\nlist\nnested\nlink' END AS structure,
    CASE WHEN list THEN '(array of 3 items)' ELSE
      'id: ' || (k + 1) || E'\nname: ''' || nm || E'''\nlong: ' || long_preview || E'\nactive: ' ||
      CASE WHEN k % 2 = 0 THEN 'True' ELSE 'False' END || E'\nnote: None\nlist: [...] (' || n ||
      E' items)\nnested: {{...}} (2 keys)\nlink: {{...}} (1 keys)' END AS skeleton,
    CASE WHEN bad OR list THEN '(no $ref imports)' ELSE '#/defs/' || nat || E'\nother.json#/' || seg END AS imports
  FROM jv)"""

YAML = f"""
y AS (
  SELECT s_suppkey AS k, s_name AS nm, s_nationkey AS nat, s_suppkey % 4 + 1 AS n,
         'conf/s' || s_suppkey || '.yml' AS path, s_suppkey % 40 = 4 AS list FROM supplier),
yaml_files AS (
  SELECT *,
    CASE WHEN list THEN E'- 1\n- 2\n' ELSE
      '# !include common/' || nat || E'.yml\nid: &id' || k || ' ' || k || E'\nname: ' || nm || E'\non: yes\nempty:\nlist: [' ||
      array_to_string(range(1, n + 1), ', ') || E']\nmap:\n  b: *id' || k || E'\n  a: text\n' END AS text,
    CASE WHEN list THEN '(array of 2 items)' ELSE E'id\nname\nTrue\nempty\nlist\nmap' END AS structure,
    CASE WHEN list THEN '(array of 2 items)' ELSE
      'id: ' || k || E'\nname: ''' || nm || E'''\nTrue: True\nempty: None\nlist: [...] (' || n ||
      E' items)\nmap: {{...}} (2 keys)' END AS skeleton,
    CASE WHEN list THEN '(no anchors or includes)'
         ELSE 'anchors: id' || k || E'\nincludes: common/' || nat || '.yml' END AS imports
  FROM y)"""

_AS = "CASE i WHEN 1 THEN ' AS first' WHEN 2 THEN ' as second' ELSE '' END"
DOCKER = f"""
d AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_custkey % 10 AS tag, CAST(o_orderkey % 3 + 1 AS INTEGER) AS n,
         o_orderpriority AS pri, 'img/' || o_orderkey || '/Dockerfile' AS path FROM orders),
docker_files AS (
  SELECT *,
    array_to_string((['first', 'second', 'stage2'])[1:n], ', ') AS stages,
    '# order ' || k || E'\nARG V=' || c || E'\n\n' ||
      {_joined("n", f"'FROM base:' || tag || {_AS} || E'\\nENV K' || i || '=' || k || E'\\nrun make \\\\\\n  all\\nEXPOSE 80' || i || chr(10)")} ||
      E'\ncmd   ["' || pri || E'"]\n' AS text,
    'stages: ' || array_to_string((['first', 'second', 'stage2'])[1:n], ', ') ||
      E'\ninstructions: ALL ARG CMD ENV EXPOSE FROM RUN' AS structure,
    'ARG V=' || c || chr(10) ||
      {_joined("n", f"'FROM base:' || tag || {_AS} || E'\\nENV K' || i || '=' || k || E'\\nEXPOSE 80' || i")} ||
      E'\nCMD ["' || pri || '"]' AS skeleton,
    {_joined("n", f"'FROM base:' || tag || {_AS}")} AS imports
  FROM d)"""

RUBY = """
rb AS (
  SELECT 'bin/n' || n_nationkey || '.rb' AS path,
    'Unsupported extension ''.rb'' in bin/n' || n_nationkey || '.rb. Supported: .dockerfile .js .json .jsx .py .svelte .ts .tsx .yaml .yml Dockerfile' AS message
  FROM nation)"""

ALL_KINDS = ",".join([PYTHON, SCRIPT, JSON, YAML, DOCKER, RUBY])


def _mixed(view: str) -> str:
    json_status = (
        "CASE WHEN bad THEN 'parse_error' ELSE 'ok' END AS status, CASE WHEN bad THEN message ELSE {0} END AS view"
        if view != "imports"
        else "'ok' AS status, {0} AS view"
    ).format(view)
    return f"""WITH {ALL_KINDS}
      SELECT path, 'python' AS kind, 'ok' AS status, {view} AS view FROM python_ok
      UNION ALL SELECT path, 'python', 'parse_error', message FROM python_bad
      UNION ALL SELECT path, 'script', 'ok', {view} FROM script_ok
      UNION ALL SELECT path, 'json', status, view FROM (SELECT path, {json_status} FROM json_files)
      UNION ALL SELECT path, 'yaml', 'ok', {view} FROM yaml_files
      UNION ALL SELECT path, 'dockerfile', 'ok', {view} FROM docker_files
      UNION ALL SELECT path, NULL, 'unsupported', message FROM rb"""


def _python_view(view: str) -> str:
    return f"""WITH {PYTHON} SELECT path, {view} AS view FROM python_ok
      UNION ALL SELECT path, message FROM python_bad"""


# ---- symbols of the Python files --------------------------------------------------------------------------------------

PYTHON_SYMBOLS = f"""{PYTHON},
m AS (SELECT *, unnest(range(1, n + 1)) AS i FROM p WHERE NOT bad),
symbols AS (
  SELECT k, n, path, 0 AS ord, 0 AS bfs_ord, 'Part' || k AS name, 'class' AS kind, false AS is_async, NULL AS parent,
         NULL AS parent_ord, 'Part' || k AS top_name, 0 AS depth, true AS listed, 7 AS start_line, 8 + 4 * n AS end_line,
         6 AS name_col, 'class Part' || k || '(Base, Sized):' AS header, nm AS doc_first FROM p WHERE NOT bad
  UNION ALL
  SELECT k, n, path, i, 1 + i, 'm_' || i, 'method', false, 'Part' || k, 0, 'Part' || k, 1, true, 6 + 4 * i, 8 + 4 * i, 8,
         'def m_' || i || '(self, size: int=' || sz || ') -> float: ...', ty || ' ' || i FROM m
  UNION ALL
  SELECT k, n, path, n + 1, 1, 'build_' || k, 'function', true, NULL, NULL, 'build_' || k, 0, true, 11 + 4 * n,
         17 + 4 * n, 10, 'async def build_' || k || '(n: int=' || sz || '): ...', 'Build ' || nm FROM p WHERE NOT bad
  UNION ALL
  SELECT k, n, path, n + 2, n + 2, 'inner_' || k, 'function', false, 'build_' || k, n + 1, 'build_' || k, 1, false,
         16 + 4 * n, 16 + 4 * n, 8, 'def inner_' || k || '(): ...', NULL FROM p WHERE NOT bad)"""


def _ints(*names: str) -> str:
    return ", ".join(f"CAST({n} AS INTEGER) AS {n}" for n in names)


# ---- lookups: req_id, path, name, status, message, result ---------------------------------------------------------------


def _python_lookup(class_result: str, method_result: str, build_result: str, first: str = "result") -> str:
    """Answers to the Python requests, from the given SQL for each kind of name."""
    return f"""
      SELECT p.k * 5 AS req_id,
        CASE WHEN p.k % 9 = 8 THEN 'src/gone_' || p.k || '.py' ELSE p.path END AS path,
        CASE p.k % 4 WHEN 0 THEN 'Part' || p.k WHEN 1 THEN 'm_1' WHEN 2 THEN 'build_' || p.k ELSE 'missing' END AS name,
        CASE WHEN p.k % 9 = 8 THEN 'not_found' WHEN p.bad THEN 'parse_error' WHEN p.k % 4 = 3 THEN 'symbol_not_found'
             ELSE 'ok' END AS status,
        CASE WHEN p.k % 9 = 8 THEN 'File not found: src/gone_' || p.k || '.py'
             WHEN p.bad THEN python_bad.message
             WHEN p.k % 4 = 3 THEN 'Symbol ''missing'' not found in ' || p.path END AS message,
        CASE WHEN p.k % 9 <> 8 THEN CASE p.k % 4 WHEN 0 THEN {class_result} WHEN 1 THEN {method_result}
             WHEN 2 THEN {build_result} END END AS {first}
      FROM p LEFT JOIN python_ok o ON p.k = o.k LEFT JOIN python_bad ON p.k = python_bad.k"""


PYTHON_BODY = _python_lookup(
    "o.class_body",
    "'    def m_1(self, size: int = ' || o.sz || E') -> float:\n        \"\"\"' || o.ty || E' 1\"\"\"\n        return size * 1'",
    "o.build_body",
)
PYTHON_CARD = _python_lookup(
    "'class Part' || o.k || E'(Base, Sized)\n' || o.nm",
    "'def m_1(self, size: int=' || o.sz || E') -> float\n' || o.ty || ' 1'",
    "'async def build_' || o.k || '(n: int=' || o.sz || E')\nBuild ' || o.nm || E'\n\n    At length.\n    '",
)
PYTHON_PLACE = _python_lookup(
    "CASE WHEN o.k IS NOT NULL THEN 6 END", "CASE WHEN o.k IS NOT NULL THEN 9 END", "10 + 4 * o.n", "line"
)
PYTHON_LISTING = """
      SELECT p.k * 5 AS req_id,
        CASE WHEN p.k % 9 = 8 THEN 'src/gone_' || p.k || '.py' ELSE p.path END AS path,
        CASE WHEN p.k % 9 = 8 THEN 'not_found' WHEN p.bad THEN 'parse_error' ELSE 'ok' END AS status,
        CASE WHEN p.k % 9 = 8 THEN 'File not found: src/gone_' || p.k || '.py' WHEN p.bad THEN python_bad.message END
          AS message,
        CASE WHEN p.k % 9 <> 8 THEN o.structure END AS result
      FROM p LEFT JOIN python_ok o ON p.k = o.k LEFT JOIN python_bad ON p.k = python_bad.k"""

SCRIPT_BODY = """
      SELECT k * 5 + 1 AS req_id, path,
        CASE k % 4 WHEN 0 THEN 'load' || k WHEN 1 THEN 'Customer' || k WHEN 2 THEN 'run' || k ELSE 'nothing' END AS name,
        CASE WHEN k % 4 = 3 THEN 'symbol_not_found' ELSE 'ok' END AS status,
        CASE WHEN k % 4 = 3 THEN 'Symbol ''nothing'' not found in ' || path END AS message,
        CASE k % 4 WHEN 0 THEN load_body WHEN 1 THEN class_body WHEN 2 THEN run_body END AS result
      FROM script_ok"""

JSON_BODY = """
      SELECT k * 5 + 2 AS req_id, path,
        CASE k % 4 WHEN 0 THEN 'id' WHEN 1 THEN 'nested' WHEN 2 THEN 'name' ELSE 'nope' END AS name,
        CASE WHEN bad THEN 'parse_error' WHEN list OR k % 4 = 3 THEN 'symbol_not_found' ELSE 'ok' END AS status,
        CASE WHEN bad THEN message
             WHEN list THEN 'Cannot look up key ''id'': root is not an object'
             WHEN k % 4 = 3 THEN 'Key ''nope'' not found. Top-level keys: id, name, long, active, note, list, nested, link'
        END AS message,
        CASE WHEN NOT bad AND NOT list THEN CASE k % 4 WHEN 0 THEN CAST(k + 1 AS VARCHAR)
          WHEN 1 THEN E'{\n  "z": {\n    "$ref": "#/defs/' || nat || E'"\n  },\n  "a": [\n    1,\n    {\n      "b": "\\\\u00e9"\n    }\n  ]\n}'
          WHEN 2 THEN '"' || nm || '"' END END AS result
      FROM json_files"""

YAML_BODY = """
      SELECT k * 5 + 3 AS req_id, path,
        CASE k % 4 WHEN 0 THEN 'list' WHEN 1 THEN 'map' WHEN 2 THEN 'id' ELSE 'nope' END AS name,
        CASE WHEN list OR k % 4 = 3 THEN 'symbol_not_found' ELSE 'ok' END AS status,
        CASE WHEN list THEN 'Cannot look up key ''list'': root is not a mapping'
             WHEN k % 4 = 3 THEN 'Key ''nope'' not found. Top-level keys: id, name, True, empty, list, map' END AS message,
        CASE WHEN NOT list THEN CASE k % 4 WHEN 0 THEN '- 1' WHEN 1 THEN E'a: text\nb: ' || k WHEN 2 THEN k || E'\n...'
          END END AS result
      FROM yaml_files"""

_STAGE = "'FROM base:' || tag || '{0}' || E'\\nENV K{1}=' || k || E'\\nRUN make \\\\\\nALL \\nEXPOSE 80{1}' || CASE WHEN n = {1} THEN E'\\nCMD [\"' || pri || '\"]' ELSE '' END"
DOCKER_BODY = f"""
      SELECT k * 5 + 4 AS req_id, path,
        CASE k % 4 WHEN 0 THEN 'env' WHEN 1 THEN 'first' WHEN 2 THEN 'second' ELSE 'nope' END AS name,
        CASE WHEN k % 4 = 3 OR (k % 4 = 2 AND n = 1) THEN 'symbol_not_found' ELSE 'ok' END AS status,
        CASE WHEN k % 4 = 3 THEN 'Stage ''nope'' not found. Stages: ' || stages
             WHEN k % 4 = 2 AND n = 1 THEN 'Stage ''second'' not found. Stages: first' END AS message,
        CASE k % 4 WHEN 0 THEN {_joined("n", "'ENV K' || i || '=' || k")}
          WHEN 1 THEN {_STAGE.format(" AS first", 1)}
          WHEN 2 THEN CASE WHEN n > 1 THEN {_STAGE.format(" as second", 2)} END END AS result
      FROM docker_files"""

# Requests without a path: what the corpus has first under each name that is asked for.
_METHODS = "(SELECT *, unnest(range(1, n + 1)) AS i FROM python_ok)"


def _anywhere(python: dict[str, list[str]], others: list[str], *columns: str) -> str:
    """Answers from the first file under each name; ``python`` has the SQL of each column for each kind of name."""
    def part(name: str, kind: str, source: str = "python_ok", more: str = "") -> str:
        results = ", ".join(f"{sql} AS {c}" for c, sql in zip(columns, python[kind]))
        return f"SELECT {name} AS name, path, {results} FROM {source} {more}"

    rows = " UNION ALL ".join([
        part("'Part' || k", "class"), part("'build_' || k", "build"), part("'inner_' || k", "inner"),
        part("'m_' || i", "method", _METHODS, "QUALIFY row_number() OVER (PARTITION BY i ORDER BY path) = 1"), *others,
    ])
    shown = ", ".join(f"CASE WHEN bad.path IS NULL THEN answers.{c} END AS {c}" for c in columns)
    return f"""WITH {ALL_KINDS},
asked AS (
  SELECT k * 3 AS req_id, CASE WHEN k % 6 = 5 THEN path END AS path,
    CASE k % 6 WHEN 1 THEN 'm_' || (k % 8 + 1) WHEN 2 THEN 'build_' || k WHEN 3 THEN 'inner_' || k WHEN 4 THEN 'nowhere_' || k
      ELSE 'Part' || k END AS name FROM p
  UNION ALL SELECT k * 3 + 1, NULL, ['load' || k, 'Customer' || k, 'run' || k, 'nested'][k % 4 + 1] FROM s
  UNION ALL SELECT k * 3 + 2, NULL, ['list', 'map', 'env', 'first'][k % 4 + 1] FROM y),
answers AS ({rows})
SELECT CAST(req_id AS BIGINT) AS req_id, coalesce(asked.path, answers.path) AS path, asked.name AS name,
  CASE WHEN bad.path IS NOT NULL THEN 'parse_error' WHEN answers.name IS NOT NULL THEN 'ok' ELSE 'symbol_not_found' END AS status,
  CASE WHEN bad.path IS NOT NULL THEN bad.message
    WHEN answers.name IS NULL THEN 'Symbol ''' || asked.name || ''' not found in the corpus' END AS message, {shown}
FROM asked LEFT JOIN answers ON asked.name = answers.name LEFT JOIN python_bad bad ON asked.path = bad.path"""


def _first_of(files: str, name: str, result: str, where: str = "true") -> str:
    return f"(SELECT '{name}', path, {result} FROM {files} WHERE {where} ORDER BY path LIMIT 1)"



# ---- paths ----------------------------------------------------------------------------------------------------------------

PATHS = """
paths AS (
  SELECT (['src', '.git', 'node_modules/x', 'a/tests', 'lib/.cache', 'dist', '__pycache__'])[p_partkey % 7 + 1] AS dir,
         (['m.py', 'v.TSX', 'Dockerfile', 'dockerfile.dev', 'x.dockerfile', 'c.yaml', 'c.JSON', '.env', 'Dockerfile.py',
           'a.b.rb', 'noext', '_x.svelte', 'app.jsx'])[(p_partkey // 7) % 13 + 1] AS name,
         p_partkey AS k FROM part)"""
NAMES = """
names(name, ext, kind, language, family) AS (VALUES
  ('m.py', '.py', 'python', 'python', 'python'),
  ('v.TSX', '.TSX', 'script', 'typescriptreact', 'typescript'),
  ('Dockerfile', '', 'dockerfile', 'plaintext', 'unknown'),
  ('dockerfile.dev', '.dev', 'dockerfile', 'plaintext', 'unknown'),
  ('x.dockerfile', '.dockerfile', 'dockerfile', 'plaintext', 'unknown'),
  ('c.yaml', '.yaml', 'yaml', 'plaintext', 'unknown'),
  ('c.JSON', '.JSON', 'json', 'plaintext', 'unknown'),
  ('.env', '', NULL, 'plaintext', 'unknown'),
  ('Dockerfile.py', '.py', 'python', 'python', 'python'),
  ('a.b.rb', '.rb', NULL, 'plaintext', 'unknown'),
  ('noext', '', NULL, 'plaintext', 'unknown'),
  ('_x.svelte', '.svelte', 'script', 'plaintext', 'unknown'),
  ('app.jsx', '.jsx', 'script', 'javascriptreact', 'typescript'))"""

TOKENS = f"""
lines AS ({DOC_LINES}),
tokens AS (SELECT DISTINCT path, line_no, unnest(regexp_extract_all(line, '{WORD}+')) AS word FROM lines)"""
PIECES = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"

USERS = """
u AS (SELECT c_custkey AS k, c_nationkey AS n, c_custkey % 8 AS way, 'app/c' || c_custkey || '.py' AS path FROM customer),
lines(way, line_no, imported, written) AS (VALUES
  (0, 1, true, true), (0, 3, true, true), (1, 3, true, true), (2, 1, false, true), (3, 2, false, true),
  (4, 1, true, true), (4, 3, true, false), (5, 1, true, false), (5, 3, true, false), (6, 3, true, false),
  (7, 1, true, true), (7, 2, false, true)),
uses AS (
  SELECT n, path, line_no, imported, written FROM u JOIN lines USING (way)
  UNION ALL SELECT n_nationkey, 'lib/nation_' || n_nationkey || '.py', 1, true, true FROM nation
  UNION ALL SELECT n_nationkey, 'lib/pack_' || n_nationkey || '/__init__.py', 1, true, true FROM nation)"""


def _reference_answers(kept: str) -> str:
    return f"""WITH {USERS}
      SELECT CAST(n AS BIGINT) AS req_id, 'Nation' || n AS name,
             CASE WHEN n % 5 = 0 THEN 'lib/nowhere.py' ELSE 'lib/nation_' || n || '.py' END AS path,
             'ok' AS status, CAST(NULL AS VARCHAR) AS message, path || ':' || line_no AS result
      FROM uses WHERE {kept}
      UNION ALL
      SELECT CAST(-1 - n_nationkey AS BIGINT), 'Nowhere' || n_nationkey, 'lib/nation_' || n_nationkey || '.py',
             'no_references', '(no references found)', NULL FROM nation"""


REPORT_ROWS = f"""
bodies AS (
  SELECT path, class_body AS body FROM python_ok UNION ALL SELECT path, build_body FROM python_ok
  UNION ALL SELECT path, '    def inner_' || k || '(): pass' FROM python_ok
  UNION ALL SELECT path, '    def m_' || i || '(self, size: int = ' || sz || E') -> float:\n        \"\"\"' || ty || ' ' || i || E'\"\"\"\n        return size * ' || i
    FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM python_ok)),
texts AS (
  SELECT path, 'python' AS kind, text, structure, skeleton, imports FROM python_ok
  UNION ALL SELECT path, 'script', text, structure, skeleton, imports FROM script_ok
  UNION ALL SELECT path, 'json', text, structure, skeleton, imports FROM json_files WHERE NOT bad
  UNION ALL SELECT path, 'yaml', text, structure, skeleton, imports FROM yaml_files
  UNION ALL SELECT path, 'dockerfile', text, structure, skeleton, imports FROM docker_files),
shown AS (
  SELECT kind, 'file' AS view, text AS t, length(text) AS whole FROM texts
  UNION ALL SELECT kind, 'structure', structure, length(text) FROM texts
  UNION ALL SELECT kind, 'skeleton', skeleton, length(text) FROM texts
  UNION ALL SELECT kind, 'imports', imports, length(text) FROM texts
  UNION ALL SELECT 'python', 'symbol_body', body, length(text) FROM bodies JOIN texts USING (path)),
sums AS (
  SELECT kind, view, count(*) AS n_views, CAST(sum(length(t)) AS BIGINT) AS chars,
         CAST(sum({PIECES.format("t")}) AS BIGINT) AS pieces, CAST(sum(whole) AS BIGINT) AS file_chars
  FROM shown GROUP BY ROLLUP (view, kind))"""

ORACLE = {
    "classified_paths": f"""WITH {PATHS}, {NAMES}
      SELECT 'repo/' || dir || '/' || k || '/' || name AS path, ext, kind, language, family FROM paths JOIN names USING (name)""",
    "pruned_paths": f"""WITH {PATHS}
      SELECT 'repo/' || dir || '/' || k || '/' || name AS path FROM paths WHERE dir IN ('src', 'dist')""",
    "decoded_documents": """
      SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'decode_error' ELSE 'ok' END AS status,
             CASE WHEN doc_id % 3 <> 0 THEN md5(text) END AS strict_md5, md5(text) AS ignore_md5,
             CAST(length(text) AS INTEGER) AS n_chars FROM documents""",
    "document_lines": DOC_LINES,
    "find_references_the": f"""WITH lines AS ({DOC_LINES})
      SELECT 'the' AS symbol, path, line_no, path || ':' || line_no AS hit FROM lines
      WHERE regexp_matches(line, '(^|{NOT_WORD})the($|{NOT_WORD})')""",
    "find_references_phrase": f"""WITH lines AS ({PAGE_LINES})
      SELECT 'track(0);</script' AS symbol, path, line_no FROM lines
      WHERE regexp_matches(line, '(^|{NOT_WORD})track\\(0\\);</script($|{NOT_WORD})')""",
    "find_references_bulk": f"""WITH {TOKENS},
      wanted AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{WORD}+')) AS word FROM benchmark)
      SELECT word AS symbol, path, line_no FROM tokens JOIN wanted USING (word)""",
    "find_references_phrases": f"""WITH lines AS ({DOC_LINES}),
      parts AS (SELECT regexp_extract_all(text, '{WORD}+') AS w, regexp_extract_all(text, '{NOT_WORD}+') AS g,
                       CASE WHEN regexp_matches(text, '^{NOT_WORD}') THEN 1 ELSE 0 END AS shift FROM benchmark),
      pairs AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || g[i + shift] || w[i + 1])) AS symbol FROM parts),
      wanted AS (SELECT DISTINCT symbol FROM pairs WHERE NOT contains(symbol, chr(10)))
      SELECT symbol, path, line_no FROM lines JOIN wanted ON contains(line, symbol)
      WHERE regexp_matches(line, '(^|{NOT_WORD})' || regexp_escape(symbol) || '($|{NOT_WORD})')""",
    "reference_requests": f"""WITH {TOKENS},
      w AS (SELECT item_id, unnest(l) AS name, generate_subscripts(l, 1) - 1 AS pos
            FROM (SELECT item_id, regexp_extract_all(text, '{WORD}+') AS l FROM benchmark)),
      r AS (SELECT min(item_id * 100000 + pos) AS req_id, name FROM w GROUP BY name
            UNION ALL SELECT -1 - item_id, 'nowhere_' || item_id FROM benchmark)
      SELECT req_id, name, path, line_no, CASE WHEN path IS NULL THEN 'no_references' ELSE 'ok' END AS status,
             CASE WHEN path IS NULL THEN '(no references found)' END AS message
      FROM r LEFT JOIN tokens ON word = name""",
    "resolved_references": f"""WITH {USERS}
      SELECT CAST(n AS BIGINT) AS req_id, 'Nation' || n AS symbol, path, CAST(line_no AS INTEGER) AS line_no,
             CASE WHEN n % 5 = 0 THEN 'text' ELSE 'resolved' END AS method, 'ok' AS status, CAST(NULL AS VARCHAR) AS message
      FROM uses WHERE CASE WHEN n % 5 = 0 THEN written ELSE imported END
      UNION ALL
      SELECT CAST(-1 - n_nationkey AS BIGINT), 'Nowhere' || n_nationkey, NULL, NULL, 'text', 'no_references',
             '(no references found)' FROM nation""",
    "scoped_references": """
      SELECT CAST(c_nationkey AS BIGINT) AS req_id, 'Nation' || c_nationkey AS symbol, 'app/c' || c_custkey || '.py' AS path,
        line_no, 'resolved' AS method, 'ok' AS status, CAST(NULL AS VARCHAR) AS message
      FROM customer JOIN (VALUES (0, 1), (0, 6), (1, 2), (1, 3), (2, 1), (2, 4), (2, 5), (3, 1), (4, 1), (4, 5), (5, 6),
        (6, 1), (6, 9)) hit(form, line_no) ON c_custkey % 7 = form
      UNION ALL SELECT n_nationkey, 'Nation' || n_nationkey, 'lib/nation_' || n_nationkey || '.py', 1, 'resolved', 'ok', NULL
      FROM nation""",
    "python_symbols_table": f"""WITH {PYTHON_SYMBOLS}
      SELECT path, name, kind, is_async, parent, top_name, listed, header, doc_first,
             {_ints("ord", "bfs_ord", "parent_ord", "depth", "start_line", "end_line", "name_col")} FROM symbols""",
    "python_imports_table": f"""WITH {PYTHON}
      SELECT path, CAST(0 AS INTEGER) AS ord, CAST(1 AS INTEGER) AS start_line, CAST(1 AS INTEGER) AS end_line,
             'import os' AS text, CAST(NULL AS VARCHAR) AS module, 'os' AS names, '' AS aliases, '1' AS name_lines, true AS top_level FROM python_ok
      UNION ALL
      SELECT path, 1, 2, 4, E'from pathlib import (\n    Path,\n)', 'pathlib', 'Path', '', '3', true FROM python_ok""",
    "python_parse_status": f"""WITH {PYTHON}
      SELECT path, CASE WHEN bad THEN 'parse_error' ELSE 'ok' END AS status,
             CASE WHEN bad THEN 'invalid syntax (<unknown>, line 1)' END AS error FROM p""",
    "python_symbol_tree": f"""WITH {PYTHON_SYMBOLS}
      SELECT path, parent, CAST(CASE WHEN kind = 'method' THEN 7 ELSE 11 + 4 * n END AS INTEGER) AS parent_line,
             name AS child, kind FROM symbols WHERE parent IS NOT NULL""",
    "python_structure": _python_view("structure"),
    "python_structure_labels": _python_view("labelled"),
    "python_skeleton": _python_view("skeleton"),
    "python_line_skeleton": _python_view("line_skeleton"),
    "python_imports_block": _python_view("imports"),
    "python_symbol_body": f"WITH {PYTHON} {PYTHON_BODY}",
    "python_symbol_card": f"WITH {PYTHON} {PYTHON_CARD}",
    "python_locate_definition": f"""WITH {PYTHON}
      SELECT req_id, path, name, status, message, CAST(line AS INTEGER) AS line,
             CAST(CASE WHEN line IS NOT NULL THEN CASE WHEN name LIKE 'Part%' THEN 6 WHEN name = 'm_1' THEN 8 ELSE 10 END END
               AS INTEGER) AS col
      FROM ({PYTHON_PLACE})""",
    "page_script_blocks": """
      SELECT 'pages/' || page_id || '.svelte' AS path,
             regexp_extract(html, '<script(?:\\s[^>]*)?>(\\s*[\\s\\S]*?)</script>', 1) AS script FROM pages""",
    "page_script_bodies": """
      SELECT 'pages/' || page_id || '.svelte' AS path,
             nullif(regexp_extract(html, '<script[^>]*>\\s*(var t="[^"]*";)', 1), '') AS body FROM pages""",
    "script_declarations": f"""WITH {SCRIPT},
      m AS (SELECT *, unnest(range(1, n + 1)) AS i FROM script_ok),
      decl AS (
        SELECT path, 0 AS ord, 'interface' AS kind, 'Shape' || k AS name, NULL AS parent, 5 AS start_line, 9 AS end_line FROM script_ok
        UNION ALL SELECT path, 1, 'type', 'Alias' || k, NULL, 11, 11 FROM script_ok
        UNION ALL SELECT path, 2, 'class', 'Customer' || k, NULL, 15, 21 + 5 * n FROM script_ok
        UNION ALL SELECT path, 3, 'constructor', 'constructor', 'Customer' || k, 18, 20 FROM script_ok
        UNION ALL SELECT path, 3 + i, 'method', 'step' || i, 'Customer' || k, 17 + 5 * i, 20 + 5 * i FROM m
        UNION ALL SELECT path, 4 + n, 'property', 'kind', 'Customer' || k, 16, 16 FROM script_ok
        UNION ALL SELECT path, 5 + n, 'function', 'load' || k, NULL, 24 + 5 * n, 26 + 5 * n FROM script_ok
        UNION ALL SELECT path, 6 + n, 'variable', 'run' || k, NULL, 28 + 5 * n, 30 + 5 * n FROM script_ok)
      SELECT path, kind, name, parent, {_ints("ord", "start_line", "end_line")} FROM decl""",
    "script_structure": f"WITH {SCRIPT} SELECT path, structure AS view FROM script_ok",
    "script_skeleton": f"WITH {SCRIPT} SELECT path, skeleton AS view FROM script_ok",
    "script_structure_labels": f"WITH {SCRIPT} SELECT path, labelled AS view FROM script_ok",
    "script_line_skeleton": f"WITH {SCRIPT} SELECT path, line_skeleton AS view FROM script_ok",
    "script_imports": f"WITH {SCRIPT} SELECT path, imports AS view FROM script_ok",
    "script_imports_table": """
      WITH given(form, start_line, end_line, module, name, local, exported) AS (VALUES
        (0, 1, 1, '../lib/n{n}', 'Nation{n}', 'Nation{n}', NULL), (1, 1, 1, '../lib/n{n}', 'Nation{n}', 'N', NULL),
        (2, 1, 1, '../lib/n{n}', '*', 'lib', NULL), (3, 1, 1, '../pack/p{n}', 'Home{n}', 'Home{n}', NULL),
        (5, 1, 3, '../pack/p{n}/index', 'Nation{n}', 'Nation{n}', NULL), (6, 1, 1, '../lib/n{n}', 'Nation{n}', 'Q', NULL),
        (7, 1, 1, '../far', 'default', 'make', NULL), (7, 1, 1, '../far', 'Nation{n}', 'Nation{n}', NULL),
        (-1, 1, 1, '../../lib/n{n}', '*', NULL, '*'), (-1, 2, 2, '../../lib/n{n}.js', 'Nation{n}', NULL, 'Home{n}')),
      files AS (
        SELECT 'app/c' || c_custkey || '.ts' AS path, c_custkey % 8 AS form, c_nationkey AS n FROM customer
        UNION ALL SELECT 'pack/p' || n_nationkey || '/index.ts', -1, n_nationkey FROM nation)
      SELECT path, start_line, end_line, replace(module, '{n}', n::VARCHAR) AS module, replace(name, '{n}', n::VARCHAR) AS name,
        replace(local, '{n}', n::VARCHAR) AS local, replace(exported, '{n}', n::VARCHAR) AS exported
      FROM files JOIN given USING (form)""",
    "script_resolved_references": """
      SELECT CAST(c_nationkey AS BIGINT) AS req_id, 'Nation' || c_nationkey AS symbol, 'app/c' || c_custkey || '.ts' AS path,
        line_no, 'ok' AS status, CAST(NULL AS VARCHAR) AS message
      FROM customer JOIN (VALUES (0, 1), (0, 2), (1, 1), (1, 3), (2, 2), (3, 1), (3, 2), (5, 2), (5, 4), (5, 5), (6, 1), (6, 2))
        hit(form, line_no) ON c_custkey % 8 = form
      UNION ALL SELECT n_nationkey, 'Nation' || n_nationkey, 'lib/n' || n_nationkey || '.ts', unnest([1, 2]), 'ok', NULL FROM nation
      UNION ALL SELECT n_nationkey, 'Nation' || n_nationkey, 'pack/p' || n_nationkey || '/index.ts', 2, 'ok', NULL FROM nation
      UNION ALL SELECT -1 - n_nationkey, 'Home' || n_nationkey, NULL, NULL, 'no_references', '(no references found)' FROM nation""",
    "script_symbol_body": f"WITH {SCRIPT} {SCRIPT_BODY}",
    "event_json_entries": """
      SELECT 'events/' || event_id || '.json' AS path, CAST(0 AS INTEGER) AS ord, unnest(json_keys(props)) AS key,
             'int' AS value_type, json_extract_string(props, '$.k') AS value_json, CAST(NULL AS INTEGER) AS n_children,
             json_extract_string(props, '$.k') AS preview, json_extract_string(props, '$.k') AS body FROM events""",
    "json_entries": f"""WITH {JSON},
      e AS (
        SELECT path, 0 AS ord, 'id' AS key, 'int' AS value_type, CAST(k + 1 AS VARCHAR) AS value_json, NULL AS n_children,
               CAST(k + 1 AS VARCHAR) AS preview FROM json_files WHERE NOT bad AND NOT list
        UNION ALL SELECT path, 1, 'name', 'str', '"' || nm || '"', NULL, '''' || nm || '''' FROM json_files WHERE NOT bad AND NOT list
        UNION ALL SELECT path, 2, 'long', 'str', '"' || repeat(nm, 6) || '"', NULL, long_preview FROM json_files WHERE NOT bad AND NOT list
        UNION ALL SELECT path, 3, 'active', 'bool', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END, NULL,
               CASE WHEN k % 2 = 0 THEN 'True' ELSE 'False' END FROM json_files WHERE NOT bad AND NOT list
        UNION ALL SELECT path, 4, 'note', 'NoneType', 'null', NULL, 'None' FROM json_files WHERE NOT bad AND NOT list
        UNION ALL SELECT path, 5, 'list', 'list', '[' || array_to_string(range(1, n + 1), ',') || ']', n,
               '[...] (' || n || ' items)' FROM json_files WHERE NOT bad AND NOT list
        UNION ALL SELECT path, 6, 'nested', 'dict', '{{"z":{{"$ref":"#/defs/' || nat || '"}},"a":[1,{{"b":"\\u00e9"}}]}}', 2,
               '{{...}} (2 keys)' FROM json_files WHERE NOT bad AND NOT list
        UNION ALL SELECT path, 7, 'link', 'dict', '{{"$ref":"other.json#/' || seg || '"}}', 1, '{{...}} (1 keys)'
               FROM json_files WHERE NOT bad AND NOT list)
      SELECT path, key, value_type, value_json, preview, {_ints("ord", "n_children")} FROM e""",
    "json_roots": f"""WITH {JSON}
      SELECT path, CASE WHEN list THEN 'list' WHEN NOT bad THEN 'dict' END AS root_type,
             CAST(CASE WHEN list THEN 3 WHEN NOT bad THEN 8 END AS INTEGER) AS n_items,
             CASE WHEN bad THEN 'parse_error' ELSE 'ok' END AS status FROM json_files""",
    "json_structure": f"""WITH {JSON} SELECT path, CASE WHEN bad THEN message ELSE structure END AS view FROM json_files""",
    "json_skeleton": f"""WITH {JSON} SELECT path, CASE WHEN bad THEN message ELSE skeleton END AS view FROM json_files""",
    "json_ref_targets": f"""WITH {JSON}
      SELECT path, CAST(0 AS INTEGER) AS ord, '#/defs/' || nat AS target FROM json_files WHERE NOT bad AND NOT list
      UNION ALL SELECT path, 1, 'other.json#/' || seg FROM json_files WHERE NOT bad AND NOT list""",
    "json_key_body": f"WITH {JSON} {JSON_BODY}",
    "yaml_entries": f"""WITH {YAML},
      e AS (
        SELECT path, 0 AS ord, 'id' AS key, 'int' AS value_type, CAST(k AS VARCHAR) AS value_json, NULL AS n_children,
               CAST(k AS VARCHAR) AS preview, k || E'\n...' AS body FROM yaml_files WHERE NOT list
        UNION ALL SELECT path, 1, 'name', 'str', '"' || nm || '"', NULL, '''' || nm || '''', nm || E'\n...' FROM yaml_files WHERE NOT list
        UNION ALL SELECT path, 2, 'True', 'bool', 'true', NULL, 'True', E'true\n...' FROM yaml_files WHERE NOT list
        UNION ALL SELECT path, 3, 'empty', 'NoneType', 'null', NULL, 'None', E'null\n...' FROM yaml_files WHERE NOT list
        UNION ALL SELECT path, 4, 'list', 'list', '[' || array_to_string(range(1, n + 1), ',') || ']', n,
               '[...] (' || n || ' items)', {_joined("n", "'- ' || i")} FROM yaml_files WHERE NOT list
        UNION ALL SELECT path, 5, 'map', 'dict', '{{"b":' || k || ',"a":"text"}}', 2, '{{...}} (2 keys)', E'a: text\nb: ' || k
               FROM yaml_files WHERE NOT list)
      SELECT path, key, value_type, value_json, preview, body, {_ints("ord", "n_children")} FROM e""",
    "yaml_structure": f"WITH {YAML} SELECT path, structure AS view FROM yaml_files",
    "yaml_skeleton": f"WITH {YAML} SELECT path, skeleton AS view FROM yaml_files",
    "yaml_key_body": f"WITH {YAML} {YAML_BODY}",
    "yaml_anchors_includes": f"""WITH {YAML},
      found AS (SELECT 'pages/' || page_id || '.yml' AS path, regexp_extract_all(html, '&({WORD}+)', 1) AS names FROM pages)
      SELECT path, 'anchor' AS kind, CAST(0 AS INTEGER) AS ord, 'id' || k AS name FROM yaml_files WHERE NOT list
      UNION ALL SELECT path, 'include', 0, 'common/' || nat || '.yml' FROM yaml_files WHERE NOT list
      UNION ALL SELECT path, 'anchor', CAST(generate_subscripts(names, 1) - 1 AS INTEGER), unnest(names) FROM found""",
    "page_yaml_imports": f"""
      WITH found AS (SELECT 'pages/' || page_id || '.yml' AS path, regexp_extract_all(html, '&({WORD}+)', 1) AS names FROM pages)
      SELECT path, CASE WHEN len(names) = 0 THEN '(no anchors or includes)' ELSE 'anchors: ' || array_to_string(names, ', ') END
        AS view FROM found""",
    "docker_instructions": f"""WITH {DOCKER},
      st AS (SELECT *, unnest(range(1, n + 1)) AS i FROM d),
      rows_ AS (
        SELECT path, 0 AS ord, 2 AS line_no, 'ARG' AS inst, 'V=' || c AS args, NULL AS stage_no FROM d
        UNION ALL SELECT path, 5 * i - 4, 6 * i - 2, 'FROM', 'base:' || tag || {_AS}, i - 1 FROM st
        UNION ALL SELECT path, 5 * i - 3, 6 * i - 1, 'ENV', 'K' || i || '=' || k, i - 1 FROM st
        UNION ALL SELECT path, 5 * i - 2, 6 * i, 'RUN', 'make ' || chr(92), i - 1 FROM st
        UNION ALL SELECT path, 5 * i - 1, 6 * i + 1, 'ALL', '', i - 1 FROM st
        UNION ALL SELECT path, 5 * i, 6 * i + 2, 'EXPOSE', '80' || i, i - 1 FROM st
        UNION ALL SELECT path, 5 * n + 1, 6 * n + 4, 'CMD', '["' || pri || '"]', n - 1 FROM d)
      SELECT path, inst, args, {_ints("ord", "line_no", "stage_no")} FROM rows_""",
    "docker_stages": f"""WITH {DOCKER}, st AS (SELECT *, unnest(range(1, n + 1)) AS i FROM d)
      SELECT path, CAST(i - 1 AS INTEGER) AS stage_no, (['first', 'second', 'stage2'])[i] AS stage_name,
             'base:' || tag AS base FROM st""",
    "docker_structure": f"WITH {DOCKER} SELECT path, structure AS view FROM docker_files",
    "docker_skeleton": f"WITH {DOCKER} SELECT path, skeleton AS view FROM docker_files",
    "docker_base_images": f"WITH {DOCKER} SELECT path, imports AS view FROM docker_files",
    "docker_body": f"WITH {DOCKER} {DOCKER_BODY}",
    "mixed_structure": _mixed("structure"),
    "mixed_skeleton": _mixed("skeleton"),
    "mixed_imports": _mixed("imports"),
    "batch_lookup_bodies": f"""WITH {ALL_KINDS}
      {PYTHON_BODY} UNION ALL {SCRIPT_BODY} UNION ALL {JSON_BODY} UNION ALL {YAML_BODY} UNION ALL {DOCKER_BODY}""",
    "batch_lookup_structure": f"WITH {PYTHON} {PYTHON_LISTING}",
    "batch_lookup_references": _reference_answers("written"),
    "batch_lookup_resolved": _reference_answers("CASE WHEN n % 5 = 0 THEN written ELSE imported END"),
    "batch_lookup_bodies_anywhere": _anywhere(
        {
            "class": ["class_body"], "build": ["build_body"], "inner": ["'    def inner_' || k || '(): pass'"],
            "method": ["'    def m_' || i || '(self, size: int = ' || sz || E') -> float:\n        \"\"\"' || ty || ' ' || i ||"
                       " E'\"\"\"\n        return size * ' || i"],
        },
        [
            *[f"SELECT '{name}' || k, path, {body} FROM script_ok"
              for name, body in (("load", "load_body"), ("Customer", "class_body"), ("run", "run_body"))],
            _first_of("json_files", "nested", "E'{\n  \"z\": {\n    \"$ref\": \"#/defs/' || nat || E'\"\n  },\n  \"a\": [\n    1,\n    {\n"
                      "      \"b\": \"\\\\u00e9\"\n    }\n  ]\n}'", "NOT bad AND NOT list"),
            _first_of("json_files", "list", "E'[\n  ' || replace(items, ', ', E',\n  ') || E'\n]'", "NOT bad AND NOT list"),
            _first_of("yaml_files", "map", "E'a: text\nb: ' || k", "NOT list"),
            _first_of("docker_files", "env", _joined("n", "'ENV K' || i || '=' || k")),
            _first_of("docker_files", "first", _STAGE.format(" AS first", 1)),
        ],
        "result",
    ),
    "batch_lookup_cards_anywhere": _anywhere(
        {
            "class": ["'class Part' || k || E'(Base, Sized)\n' || nm"],
            "build": ["'async def build_' || k || '(n: int=' || sz || E')\nBuild ' || nm || E'\n\n    At length.\n    '"],
            "inner": ["'def inner_' || k || '()'"],
            "method": ["'def m_' || i || '(self, size: int=' || sz || E') -> float\n' || ty || ' ' || i"],
        },
        [],
        "result",
    ),
    "batch_lookup_locations_anywhere": _anywhere(
        {kind: [f"CAST({line} AS INTEGER)", f"CAST({col} AS INTEGER)"] for kind, line, col in (
            ("class", "6", "6"), ("method", "5 + 4 * i", "8"), ("build", "10 + 4 * n", "10"), ("inner", "15 + 4 * n", "8"))},
        [],
        "line", "col",
    ),
    "view_cost_report": f"""WITH {ALL_KINDS}, {REPORT_ROWS}
      SELECT kind, view, n_views, chars, pieces, file_chars, round(1 - chars / file_chars, 6) AS saved
      FROM sums WHERE view IS NOT NULL""",
    "view_size_distribution": f"""WITH {ALL_KINDS}, {REPORT_ROWS}
      SELECT kind, view, count(*) AS n_views, quantile_disc(length(t), 0.5) AS p50, quantile_disc(length(t), 0.9) AS p90,
        quantile_disc(length(t), 0.99) AS p99, max(length(t)) AS most
      FROM shown GROUP BY ROLLUP (view, kind) HAVING view IS NOT NULL""",
}
