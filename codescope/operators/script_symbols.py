"""TypeScript, JavaScript and Svelte files, read lexically.

A small scanner cuts the text of one file into its top-level statements, and those of class and interface bodies;
brackets nest, so a regular expression cannot. What the statements declare, and every view of them, is decided by
column expressions on the scanned array. Types are shown as written, never inferred.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import messages
from ..functions.batches import by_slices, read_back, written
from ..functions.text import SPACES, join_or, label, let, normalize_newlines

_MEMBER_FIELDS = "start_line int, end_line int, code string, head string, doc string"
STATEMENT = f"off int, len int, {_MEMBER_FIELDS}, members array<struct<{_MEMBER_FIELDS}>>"
_MEMBER_ARROW = [
    ("start_line", pa.int32()), ("end_line", pa.int32()), ("code", pa.string()), ("head", pa.string()),
    ("doc", pa.string()),
]
_ARROW = pa.list_(
    pa.struct(
        [("off", pa.int32()), ("len", pa.int32()), *_MEMBER_ARROW, ("members", pa.list_(pa.struct(_MEMBER_ARROW)))]
    )
)

# Fixed value: the first script element of a page or component.
SCRIPT_ELEMENT = r"<script(?:\s[^>]*)?>(\s*[\s\S]*?)</script>"

_QUOTED = r'"(?:\\[\s\S]|[^"\\\n])*"' r"|'(?:\\[\s\S]|[^'\\\n])*'"
_EVENT = re.compile(rf"(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<quoted>{_QUOTED})|[`/(){{}}]")
_TEMPLATE_TEXT = re.compile(r"(?:[^`\\$]+|\\[\s\S]|\$(?!\{)|\\\Z)*")
_PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/")
_LAST_WORD = re.compile(r"(?<![\w$.])[\w$]+\Z")
_CONDITION = frozenset(("if", "while", "for", "with"))
# After these, and after nothing at all, comes a value: a slash opens a pattern and a brace an object.
_OPENS_VALUE = frozenset("( , = : [ ! & | ? return typeof case in of delete void throw new".split())
_BEFORE_PATTERN = _OPENS_VALUE | frozenset(("{", ";", "=>", "condition)", "block}", "else", "do"))
_MARK = re.compile(r"[{}()\[\];\n]")
_VISIBLE = re.compile(r"\S")
_BLOCK = re.compile(
    r"\s*(?:@[\w$.]+\s*(?:\(\s*\))?\s*)*(?:(?:export|default|declare|abstract|async)\s+)*"
    r"(?:class|function|interface|enum|const\s+enum|namespace|module|global|if|else|for|while|do|switch|try|catch|finally)\b"
)
_GOES_ON = re.compile(r"(?:[=,+\-*/%&|^?:.(\[{!~]|=>|\b(?:extends|implements|return|typeof|new|in|of|as|from))\Z")
_CONTINUES = re.compile(r"[.,?:=+\-*/%&|^<>)\]}(\[`{]|(?:instanceof|in|as|satisfies|extends|implements|from)\b")
_MEMBER_CONTINUES = re.compile(r"[.,?:=+/%&|^>)\]}{]|(?:extends|is)\b")
_DECORATORS = re.compile(r"\s*(?:@[\w$.]+\s*(?:\(\s*\))?\s*)+\Z")
_DECORATED = re.compile(r"\s*@")
_TAIL = 16  # characters that decide whether a line goes on: more than the longest word in _GOES_ON
_GLUED = re.compile(r">[\w$]")
_DOC = re.compile(r"/\*\*(?!/)([\s\S]*?)\*/")


def _last_token(text: str, lo: int, at: int, before: str) -> str:
    """The last word, arrow or sign of ``text[lo:at]``, else ``before``, which stands ahead of it."""
    piece = text[lo:at].rstrip()
    if not piece:
        return before
    word = _LAST_WORD.search(piece[-_TAIL:])
    return word.group() if word else "=>" if piece.endswith("=>") else piece[-1]


def _replaced(text: str, spans: list[tuple[int, int, bool]], comments_only: bool) -> str:
    pieces, at = [], 0
    for start, end, is_comment in spans:
        if is_comment or not comments_only:
            lines = text[start:end].split("\n") if is_comment else [text[start:end]]
            pieces += [text[at:start], "\n".join(" " * len(line) for line in lines)]
            at = end
    return "".join([*pieces, text[at:]])


def _quieted(text: str) -> tuple[str, str]:
    """``text`` without comments, and also without the insides of strings, templates and patterns; offsets stay.

    One pass. What is open is kept on a stack, so that templates inside templates end where they should. Whether a slash
    divides or opens a pattern is told by the token before it.
    """
    spans: list[tuple[int, int, bool]] = []
    opened: list[str] = []  # "(", "condition(", "object{", "block{", and "${" in templates
    templates = braces = 0
    outermost = 0  # where the outermost open template begins
    at, lo, token = 0, 0, ";"
    while found := _EVENT.search(text, at):
        (start, at), group = found.span(), found.lastgroup
        in_template = False
        if group == "comment":
            token = _last_token(text, lo, start, token)
            if not templates:
                spans.append((start, at, True))
            lo = at
            continue
        if group == "quoted":
            token = '"'
            if not templates:
                spans.append((start + 1, at - 1, False))
            lo = at
            continue
        sign = text[start]
        before = _last_token(text, lo, start, token) if sign in "/({" else token  # what stands ahead of others is never asked
        token = sign
        if sign == "`":
            outermost = outermost if templates else start
            in_template = True
        elif sign == "/":
            # ``/>`` after a brace closes an element.
            whole = before in _BEFORE_PATTERN and not (before == "block}" and text.startswith("/>", start))
            pattern = _PATTERN.match(text, start) if whole else None
            if pattern:
                at, token = pattern.end(), '"'
                if not templates:
                    spans.append((start + 1, at - 1, False))
        elif sign == "(":
            opened.append("condition(" if before in _CONDITION else "(")
        elif sign == ")":
            if opened and opened[-1].endswith("("):
                token = opened.pop().replace("(", ")")
        elif sign == "{":
            opened.append("object{" if before in _OPENS_VALUE else "block{")
            braces += 1
        elif braces or templates:
            while opened[-1].endswith("("):
                opened.pop()
            last = opened.pop()
            in_template = last == "${"
            braces -= not in_template
            templates -= in_template
            token = "block}" if last == "block{" else "}"
        if in_template:
            at = _TEMPLATE_TEXT.match(text, at).end()
            if text.startswith("${", at):
                opened.append("${")
                templates += 1
                at, token = at + 2, "("
            else:
                if not templates:
                    spans.append((outermost + 1, min(at, len(text)), False))
                at, token = at + 1, '"'
        lo = at
    if templates:
        spans.append((outermost + 1, len(text), False))
    return _replaced(text, spans, True), _replaced(text, spans, False)


def _statements(code: str, lo: int, hi: int, inside: bool) -> Iterator[tuple[int, int, str, int | None]]:
    """(start, end, outline, body start) of each statement in ``code[lo:hi]``.

    The outline has nothing inside its brackets. A statement ends at ``;``, after the block of a declaration, or at a
    line end when neither side of it calls for more.
    """
    continues = _MEMBER_CONTINUES if inside else _CONTINUES
    depth, start, kept, outline, opened = 0, lo, lo, "", None
    looked, last = lo, lo  # up to where the code was looked at, and the end of the last visible character before that
    ahead = lo - 1  # the first visible character at or behind the last place asked for

    def visible(at: int) -> int:
        """The first visible character from ``at`` on, else ``hi``. Places come in order, so blanks are passed once."""
        nonlocal ahead
        if ahead < at:
            found = _VISIBLE.search(code, at, hi)
            ahead = found.start() if found else hi
        return ahead

    def cut(end: int, body: int | None):
        text = code[start:end]
        lead = len(text) - len(text.lstrip())
        if text.strip(" \t\n;"):
            yield start + lead, start + len(text.rstrip()), (outline + code[kept:end]).strip(), body

    for mark in _MARK.finditer(code, lo, hi):
        sign, at = mark.group(), mark.start()
        if sign in "{([":
            if depth == 0:
                outline += code[kept : at + 1]
                opened = at
            depth += 1
            continue
        body = None
        if sign in "})]":
            depth = max(depth - 1, 0)
            if depth:
                continue
            kept = at
            is_block = "=" not in outline if inside else _BLOCK.match(outline)
            if sign != "}" or not is_block:
                continue
            following = visible(at + 1)
            if following < hi and code[following] in "{>,)|&[.=;":
                continue
            body = opened
        elif depth:
            continue
        elif sign == "\n":
            seen = code[looked:at].rstrip()
            if seen:
                last = looked + len(seen)
            looked = at
            tail = code[max(kept, last - _TAIL) : last] if last > kept else outline[-_TAIL:].rstrip()
            if (
                not tail.strip()
                or _GOES_ON.search(tail)
                or (visible(at) < hi and continues.match(code, ahead))
                or (_DECORATED.match(code, start) and _DECORATORS.match(outline + code[kept:last]))
            ):
                continue
        yield from cut(at + 1, body)
        start, kept, outline, opened = at + 1, at + 1, "", None
        looked = last = at + 1
    yield from cut(hi, None)


def _first_doc(gap: str) -> str | None:
    """First line of the description in the first documentation comment of ``gap``."""
    found = _DOC.search(gap)
    if not found:
        return None
    lines = [re.sub(r"^\s*\*? ?", "", line).rstrip() for line in found[1].split("\n")]
    for n, line in enumerate(lines):
        if line.startswith("@"):
            lines = lines[:n]
            break
    return next((line.strip() for line in lines if line.strip()), None)


def _squash(text: str) -> str:
    return " ".join(text.split())


def _scan_one(text: str) -> list[tuple]:
    bare, code = _quieted(text)
    line_ends = [m.start() for m in re.finditer("\n", text)]

    def line_of(at: int) -> int:
        return bisect_left(line_ends, at) + 1

    def described(start: int, end: int, outline: str, body: int | None, previous: int) -> tuple:
        head = bare[start : end if body is None else body]
        gap = text[previous:start]
        return (
            line_of(start), line_of(end - 1), _squash(outline), _squash(head).rstrip(" ;,"),
            _first_doc(gap) if "/**" in gap else None,
        )

    rows, previous = [], 0
    for start, end, outline, body in _statements(code, 0, len(code), False):
        row = described(start, end, outline, body, previous)
        members, inner = [], None if body is None else body + 1
        if inner is not None and re.search(r"\b(?:class|interface)\b", outline):
            for s, e, o, b in _statements(code, body + 1, end - 1, True):
                members.append(described(s, e, o, b, inner))
                inner = e
        rows.append((start, end - start, *row, members))
        previous = end
    return rows


def _outlines(text: str, names: list[str | None] | None = None) -> list[tuple]:
    """Place and code of each statement, and nothing of its members. With ``names``, of those that may declare one of them:
    a file that has none is not read. Text that is glued together where type arguments are cut out may declare any."""
    if names is not None:
        names = [n for n in names if n is not None]
        if not any(n in text for n in names) and not _GLUED.search(text):
            return []
    code = _quieted(text)[1]
    return [
        (start, end - start, None, None, _squash(outline), None, None, None)
        for start, end, outline, _ in _statements(code, 0, len(code), False)
        if names is None or any(n in outline for n in names) or _GLUED.search(outline)
    ]


def _scanned(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _scan_one(t) for t in texts.to_pylist()], _ARROW)


def _scan(texts: pa.Array) -> pa.Array:
    return pa.nulls(len(texts), _ARROW) if texts.null_count == len(texts) else by_slices(_scanned, texts)


def _scanned_outlines(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _outlines(t) for t in texts.to_pylist()], _ARROW)


def _scan_outlines(texts: pa.Array) -> pa.Array:
    return pa.nulls(len(texts), _ARROW) if texts.null_count == len(texts) else by_slices(_scanned_outlines, texts)


def _scanned_for(texts: pa.Array, names: pa.Array) -> pa.Array:
    each = zip(texts.to_pylist(), read_back(names), strict=True)
    return pa.array([None if t is None else _outlines(t, n) for t, n in each], _ARROW)


def _scan_for(texts: pa.Array, names: pa.Array) -> pa.Array:
    return pa.nulls(len(texts), _ARROW) if texts.null_count == len(texts) else by_slices(_scanned_for, texts, names)


_scan.__annotations__ = _scan_outlines.__annotations__ = {"texts": pa.Array, "return": pa.Array}
_scan_for.__annotations__ = {"texts": pa.Array, "names": pa.Array, "return": pa.Array}


def script_block(text: Column) -> Column:
    """Content of the first ``<script>`` element, empty when there is none."""
    return F.regexp_extract(text, SCRIPT_ELEMENT, 1)


def script_blocks(files: DataFrame) -> DataFrame:
    """(path, script)."""
    return files.select("path", script_block(F.col("text")).alias("script"))


def script_text(path: Column, text: Column) -> Column:
    """What is parsed of a file: the script block of ``.svelte`` files, else everything."""
    plain = normalize_newlines(text)
    return F.when(F.lower(path).endswith(".svelte"), script_block(plain)).otherwise(plain)


def scanned_script(text: Column, names: Column | None = None, outlines: bool = False) -> Column:
    """array<statement> of a script; null text gives null. ``outlines`` leaves out all but what ``symbol_body`` and
    ``body_names`` read; with ``names``, an array in each row, so it is of the statements that may declare one of them."""
    statements = f"array<struct<{STATEMENT}>>"
    if names is None:
        return F.arrow_udf(_scan_outlines if outlines else _scan, statements).asNondeterministic()(text)
    return F.arrow_udf(_scan_for, statements).asNondeterministic()(text, written(names, text.isNotNull()))


def scan_scripts(files: DataFrame) -> DataFrame:
    """Files with ``script`` (the text that was read) and ``statements``. Filter files before this, not after."""
    scripts = files.withColumn("script", script_text(F.col("path"), F.col("text")))
    return scripts.withColumn("statements", scanned_script(F.col("script")))


# ---- what a statement declares ---------------------------------------------------------------------------------

_ID = r"[\p{L}\p{N}_$]+"
_LEAD = r"^(?:@[\w$.]+ ?(?:\(\))? ?)*(?:(?:export|default|declare|abstract|async) )*"
_MODIFIERS = r"^(?:@[\w$.]+ ?(?:\([^()]*\))? ?|(?:public|private|protected|static|readonly|override|abstract|async|declare|accessor) (?! ?[(:=?;])|\* ?)*"
_ASYNC = r"^(?:@[\w$.]+ ?(?:\(\))? ?)*(?:[a-z]+ )*?async [^(:=]"
_NAME = rf"(?:\[\]|\#?{_ID}|\"[^\"]*\"|'[^']*')"
_INTERFACE = rf"{_LEAD}interface ({_ID})"
_ALIAS = rf"{_LEAD}type ({_ID})[^=]*="
_CLASS = rf"{_LEAD}class\b(?: (?!extends\b|implements\b)({_ID}))?"
_FUNCTION = rf"{_LEAD}function\b ?\*? ?({_ID})?"
_ENUM = rf"{_LEAD}(?:const )?enum ({_ID})"
_VARIABLE = rf"{_LEAD}(?:const|let|var) (?!enum\b)"
_IMPORT = rf"^import\b(?! ?[(.])(?! (?:type )?{_ID} ?=)"
_CONSTRUCTOR = rf"{_MODIFIERS}constructor ?\("
_ACCESSOR = rf"{_MODIFIERS}(?:get|set) {_NAME} ?\("
_METHOD = rf"{_MODIFIERS}({_NAME})[?!]? ?(?:<.*?> ?)?\("
_PROPERTY = rf"{_MODIFIERS}({_NAME})[?!]? ?(?:[:=;,].*)?$"
_FUNCTION_VALUE = rf"(?:^|,) ?({_ID}) ?(?::(?:[^=,]|=>)*)?=(?!>) ?(?:async )?(?:function\b|(?:<[^=]*> ?)?\(\)[^=]*=>|{_ID} ?=>)"


def _name(x: Column, pattern: str) -> Column:
    return F.regexp_extract(x["code"], pattern, 1)


def _is(x: Column, pattern: str) -> Column:
    return x["code"].rlike(pattern)


def _member_kind(m: Column) -> Column:
    return (
        F.when(_is(m, _CONSTRUCTOR), "constructor")
        .when(_is(m, _ACCESSOR), "accessor")
        .when(_is(m, _METHOD) & ~m["code"].rlike(rf"{_MODIFIERS}{_NAME}[?!]? ?[:=]"), "method")
        .when(_is(m, _PROPERTY) & ~m["code"].rlike(r"^(?:static ?)?\{|^\[\]"), "property")
    )


def _member_name(m: Column) -> Column:
    name = F.coalesce(*[F.nullif(_name(m, p), F.lit("")) for p in (_METHOD, _PROPERTY)])
    # The insides of strings are blank in ``code``.
    quoted = F.regexp_extract(m["head"], rf"{_MODIFIERS}({_NAME})", 1)
    return F.when(_is(m, _CONSTRUCTOR), "constructor").when(name.rlike("^[\"']"), quoted).otherwise(name)


def _of_kind(members: Column, kind: str) -> Column:
    return F.filter(members, lambda m: _member_kind(m) == kind)


def _declarators(x: Column) -> Column:
    """A variable statement without its keyword and type arguments."""
    return F.regexp_replace(F.regexp_replace(x["code"], _VARIABLE, ""), r"<[^<>=]*>", "")


def _function_variables(x: Column) -> Column:
    return F.regexp_extract_all(_declarators(x), F.lit(_FUNCTION_VALUE), F.lit(1))


def _variables(x: Column) -> Column:
    return F.regexp_extract_all(_declarators(x), F.lit(rf"(?:^|,) ?({_ID})[!]? ?(?=[:=,;]|$)"), F.lit(1))


def _class_name(x: Column) -> Column:
    return F.coalesce(F.nullif(_name(x, _CLASS), F.lit("")), F.lit("(anonymous)"))


def declarations(statements: Column) -> Column:
    """array<struct<kind, name, parent, start_line, end_line>> in listing order.

    Interfaces, type aliases, classes (each with constructors, methods, properties), named functions, then variables
    that hold a function.
    """
    def entry(kind: str, name: Column, at: Column, parent: Column | None = None) -> Column:
        owner = F.lit(None).cast("string") if parent is None else parent
        return F.struct(
            F.lit(kind).alias("kind"), name.alias("name"), owner.alias("parent"),
            at["start_line"].alias("start_line"), at["end_line"].alias("end_line"),
        )

    def each(pattern: str, build) -> Column:
        return F.transform(F.filter(statements, lambda x: _is(x, pattern)), build)

    def with_members(x: Column) -> Column:
        def members(kind: str) -> Column:
            return F.transform(
                _of_kind(x["members"], kind), lambda m: entry(kind, _member_name(m), m, _class_name(x))
            )

        own = F.array(entry("class", _class_name(x), x))
        return F.concat(own, members("constructor"), members("method"), members("property"))

    functions = F.filter(statements, lambda x: _is(x, _FUNCTION) & (_name(x, _FUNCTION) != ""))
    variables = F.flatten(
        each(_VARIABLE, lambda x: F.transform(_function_variables(x), lambda n: entry("variable", n, x)))
    )
    return F.concat(
        each(_INTERFACE, lambda x: entry("interface", _name(x, _INTERFACE), x)),
        each(_ALIAS, lambda x: entry("type", _name(x, _ALIAS), x)),
        F.flatten(each(_CLASS, with_members)),
        F.transform(functions, lambda x: entry("function", _name(x, _FUNCTION), x)),
        variables,
    )


def script_declarations(scanned: DataFrame) -> DataFrame:
    """(path, ord, kind, name, parent, start_line, end_line): one row per declaration."""
    rows = scanned.select("path", F.posexplode(declarations(F.col("statements"))).alias("ord", "d"))
    return rows.select("path", "ord", "d.*")


def structure(statements: Column, labels: bool = False) -> Column:
    """Names of declarations and, indented, of class members. With ``labels`` each has its kind in front, kinds without
    a label have none, and properties are left out."""
    def line(d: Column) -> Column:
        indent = F.when(d["parent"].isNotNull(), "  ").otherwise("")
        return F.concat(indent, label(d["kind"]) if labels else F.lit(""), d["name"])

    listed = declarations(statements)
    if labels:
        listed = F.filter(listed, lambda d: d["kind"] != "property")
    return join_or(F.transform(listed, line), messages.NO_SYMBOLS)


def line_skeleton(statements: Column, script: Column) -> Column:
    """First source line of each declaration and class member as written, a blank line between groups; no variables."""
    def lines(source: Column) -> Column:
        def shown(kept: Column) -> Column:
            return F.flatten(
                F.transform(
                    kept,
                    lambda d, i: F.array_compact(
                        F.array(
                            F.get(source, d["start_line"] - 1),
                            F.when(F.get(kept, i + 1)["parent"].isNull(), F.lit("")),
                        )
                    ),
                )
            )

        return let(F.filter(declarations(statements), lambda d: d["kind"] != "variable"), shown)

    text = F.array_join(let(F.split(script, "\n"), lines), "\n")
    return let(text, lambda t: F.when(t == "", F.lit(messages.NO_SYMBOLS)).otherwise(F.rtrim(t, F.lit(SPACES))))


def _doc_line(doc: Column, indent: str) -> Column:
    return F.when(doc.isNotNull(), F.concat(F.lit(f"{indent}/** "), doc, F.lit(" */")))


def skeleton(statements: Column) -> Column:
    """Interface properties, class and function signatures as written, first documentation lines; no bodies."""
    def signature(x: Column) -> Column:
        asynchronous = F.when(x["code"].rlike(_ASYNC), F.lit("async ")).otherwise("")
        return F.concat(asynchronous, F.regexp_replace(x["head"], _MODIFIERS, ""))

    def property_line(m: Column) -> Column:
        written = F.regexp_extract(F.regexp_replace(m["head"], _MODIFIERS, ""), rf"^{_NAME}[?!]? ?: ?(.*)$", 1)
        return F.concat(
            F.lit("  "), _member_name(m), F.lit(": "), F.when(written != "", written).otherwise(F.lit("any"))
        )

    def interface(x: Column) -> Column:
        return F.concat(
            F.array(F.concat(F.lit("interface "), _name(x, _INTERFACE), F.lit(" {"))),
            F.transform(_of_kind(x["members"], "property"), property_line),
            F.array(F.lit("}"), F.lit("")),
        )

    def class_(x: Column) -> Column:
        constructors = F.transform(
            _of_kind(x["members"], "constructor"),
            lambda m: F.concat(F.lit("  "), F.regexp_replace(m["head"], _MODIFIERS, "")),
        )
        methods = F.flatten(
            F.transform(
                _of_kind(x["members"], "method"),
                lambda m: F.array_compact(F.array(F.concat(F.lit("  "), signature(m)), _doc_line(m["doc"], "    "))),
            )
        )
        opening = F.array(F.concat(F.lit("class "), _class_name(x), F.lit(" {")), _doc_line(x["doc"], "  "))
        return F.concat(F.array_compact(opening), constructors, methods, F.array(F.lit("}"), F.lit("")))

    def function(x: Column) -> Column:
        written = F.regexp_replace(x["head"], r"^(?:(?:export|default|declare) )*", "")
        return F.array_compact(F.array(written, _doc_line(x["doc"], "  ")))

    def all_of(pattern: str, build) -> Column:
        return F.flatten(F.transform(F.filter(statements, lambda x: _is(x, pattern)), build))

    lines = F.concat(all_of(_INTERFACE, interface), all_of(_CLASS, class_), all_of(_FUNCTION, function))
    # Like any joined list, an empty first result reads as "nothing found".
    return let(F.array_join(lines, "\n"), lambda s: F.when(s == "", F.lit(messages.NO_SYMBOLS)).otherwise(s))


def symbol_body(statements: Column, script: Column, name: Column) -> Column:
    """Text of the class, function, interface or variable statement of that name, the later kind and place winning."""
    def candidates(pattern: str, named, rank: int) -> Column:
        return F.transform(
            F.filter(statements, lambda x: _is(x, pattern) & named(x)),
            lambda x: F.struct(F.lit(rank).alias("rank"), x["off"].alias("off"), x["len"].alias("len")),
        )

    best = F.array_max(
        F.concat(
            candidates(_CLASS, lambda x: _name(x, _CLASS) == name, 0),
            candidates(_FUNCTION, lambda x: _name(x, _FUNCTION) == name, 1),
            candidates(_INTERFACE, lambda x: _name(x, _INTERFACE) == name, 2),
            candidates(_VARIABLE, lambda x: F.array_contains(_variables(x), name), 3),
        )
    )
    return F.nullif(let(best, lambda b: F.substr(script, b["off"] + 1, b["len"])), F.lit(""))


def statement_names(x: Column) -> Column:
    """The names that a statement declares: of a class, function, interface, type or enumeration, or of variables."""
    named = F.array(*[_name(x, p) for p in (_CLASS, _FUNCTION, _INTERFACE, _ALIAS, _ENUM)])
    variables = F.when(_is(x, _VARIABLE), _variables(x)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(named, variables), lambda n: n != ""))


def body_names(statements: Column) -> Column:
    """Every name that ``symbol_body`` answers: of classes, functions, interfaces and variables."""
    kept = F.filter(statements, lambda x: ~_is(x, _ALIAS) & ~_is(x, _ENUM))
    return F.array_distinct(F.flatten(F.transform(kept, statement_names)))


def imports_block(statements: Column, script: Column) -> Column:
    """ES imports as written, then variable statements that mention ``require(``."""
    def written(x: Column) -> Column:
        return F.substr(script, x["off"] + 1, x["len"])

    imports = F.transform(F.filter(statements, lambda x: _is(x, _IMPORT)), written)
    variables = F.transform(F.filter(statements, lambda x: _is(x, _VARIABLE)), written)
    return join_or(F.concat(imports, F.filter(variables, lambda v: F.contains(v, F.lit("require(")))), messages.NO_IMPORTS)
