"""Per-file views of parsed Python files, as row-local expressions on the ``parsed`` column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import messages
from ..functions.text import SPACES, join_or, label, let, strip
from .python_symbols import doc_first, header

TRIPLE_QUOTES = ('"""', "'''")


def _listed(parsed: Column) -> Column:
    return F.filter(parsed["symbols"], lambda s: s["listed"])


def structure(parsed: Column, labels: bool = False) -> Column:
    """Names of top-level definitions and, indented, their direct methods."""
    def line(s: Column) -> Column:
        return F.concat(
            F.when(s["depth"] > 0, "  ").otherwise(""), label(s["kind"]) if labels else F.lit(""), s["name"]
        )

    return join_or(F.transform(_listed(parsed), line), messages.NO_SYMBOLS)


def _ends_group(symbols: Column, position: Column) -> Column:
    """True when the next listed symbol is a top-level one, or there is none."""
    return F.coalesce(F.get(symbols, position + 1)["depth"] == 0, F.lit(True))


def skeleton(parsed: Column) -> Column:
    """Headers with signatures and first doc lines; a blank line after each class."""
    def lines(symbols: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            indent = F.when(s["depth"] > 0, "    ").otherwise("")
            head = F.concat(indent, header(s))
            doc = let(doc_first(s), lambda d: F.when(d != "", F.concat(indent, F.lit('    """'), d, F.lit('"""'))))
            blank = F.when(((s["kind"] == "class") | (s["depth"] > 0)) & _ends_group(symbols, i), F.lit(""))
            return F.array_compact(F.array(head, doc, blank))

        return F.flatten(F.transform(symbols, one))

    return join_or(let(_listed(parsed), lines), messages.NO_SYMBOLS)


def _quoted_doc(line: Column) -> Column:
    """The doc line to print when ``line`` opens a triple-quoted string with text in it, else null."""
    text = strip(line)
    indent = F.repeat(F.lit(" "), F.length(line) - F.length(F.ltrim(line, F.lit(SPACES))))

    def shown(quote: str) -> Column:
        rest = F.substr(text, F.lit(4))
        closed = F.when(rest.endswith(quote), strip(F.substr(rest, F.lit(1), F.length(rest) - 3))).otherwise(rest)
        return F.when(
            text.startswith(quote) & (closed != ""), F.concat(indent, F.lit('"""'), closed, F.lit('"""'))
        )

    return F.coalesce(*[shown(q) for q in TRIPLE_QUOTES])


def line_skeleton(parsed: Column) -> Column:
    """First source line of each definition as written, with the doc line right below it; a blank line between groups."""
    def lines(symbols: Column) -> Column:
        return F.flatten(
            F.transform(
                symbols,
                lambda s, i: F.array_compact(
                    F.array(
                        s["first_line"], _quoted_doc(s["next_line"]), F.when(_ends_group(symbols, i), F.lit(""))
                    )
                ),
            )
        )

    text = F.array_join(let(_listed(parsed), lines), "\n")
    return F.when(F.size(parsed["symbols"]) == 0, messages.NO_SYMBOLS).otherwise(
        F.rtrim(text, F.lit(SPACES))
    )


def imports_block(parsed: Column) -> Column:
    """Module-level imports in full; statements sharing a line show that line once."""
    def texts(imports: Column) -> Column:
        kept = F.filter(
            imports, lambda m, i: (i == 0) | (m["start_line"] > F.get(imports, i - 1)["start_line"])
        )
        return F.transform(kept, lambda m: m["text"])

    return join_or(let(F.filter(parsed["imports"], lambda m: m["top_level"]), texts), messages.NO_IMPORTS)


def first_named(parsed: Column, name: Column) -> Column:
    """The symbol with that name that comes first breadth-first, or null."""
    return F.get(F.filter(parsed["symbols"], lambda s: s["first_named"] & (s["name"] == name)), F.lit(0))


def symbol_body(parsed: Column, text: Column, name: Column) -> Column:
    """Source lines of the first symbol with that name; null when there is none. ``text`` has ``\\n`` line ends."""
    return let(first_named(parsed, name), lambda s: F.substr(text, s["body_off"] + 1, s["body_len"]))


def location(parsed: Column, name: Column) -> Column:
    """struct<line, col>, both from 0, of the name in the first definition of it; null when there is none."""
    return let(
        first_named(parsed, name),
        lambda s: F.when(
            s.isNotNull(), F.struct((s["start_line"] - 1).alias("line"), s["name_col"].alias("col"))
        ),
    )


def symbol_card(parsed: Column, name: Column) -> Column:
    """Signature, then the whole docstring if there is one; null when there is no such symbol."""
    return let(
        first_named(parsed, name),
        lambda s: F.when(
            s.isNotNull(),
            F.concat_ws("\n", F.regexp_replace(header(s), r":( \.\.\.)?\z", ""), s["doc_full"]),
        ),
    )


def with_view(parsed_files: DataFrame, view: Column) -> DataFrame:
    """(path, view), with the parse error in place of the view where there is one."""
    message = messages.parse_error(F.col("path"), F.col("parsed.error"))
    return parsed_files.select("path", F.coalesce(message, view).alias("view"))
