"""Chat formatting in budgeted windows of whole turns, with a mask for the loss."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codescope.plans.lineage import stored

from .token_counts import Tokenizer

BUDGET, HISTORY = 2_048, 512
TARGET_ROLE, SYSTEM_ROLE = "assistant", "system"
#: Successive turns whose numbers of tokens are summed together before the sums of a conversation meet.
BLOCK_TURNS = 1_024


@dataclass(frozen=True)
class Template:
    """Marks turns as ``open role \\n text close``; control strings inside roles and texts are escaped reversibly.

    A backslash after the first character of a control string, or of an escaped one, is added by ``escape`` and taken
    away by ``unescape``. No control string holds the first character of any elsewhere, so escaping makes none.
    """

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
    _plain: re.Pattern = field(init=False, repr=False, compare=False)
    _escaped: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        firsts = {c[0] for c in self.controls}
        if any(len(c) < 2 or firsts & set(c[1:]) or c[1] == "\\" for c in self.controls):
            raise ValueError("a control string must not hold the first character of one")
        if not any(self.open.startswith(c) for c in self.controls) or not any(self.close.startswith(c) for c in self.controls):
            raise ValueError("turn marks must start with a control string")
        tails = [rf"(?<={re.escape(c[0])})(\\*)(?={re.escape(c[1:])})" for c in self.controls]
        object.__setattr__(self, "_plain", re.compile("|".join(tails)))
        object.__setattr__(self, "_escaped", re.compile("|".join(t.replace(r"(\\*)", r"\\(\\*)") for t in tails)))

    def escape(self, text: str) -> str:
        return self._plain.sub(lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[0][1:], text)

    def head(self, role: str) -> str:
        """The mark of a turn; a role is one line."""
        return f"{self.open}{self.escape(role.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n"

    def turn(self, role: str, text: str) -> str:
        return f"{self.head(role)}{self.escape(text)}{self.close}"

    def parse(self, formatted: str) -> Iterator[tuple[str, int, int]]:
        """(role, start, end) of each turn; the range is that of its escaped text."""
        at = 0
        while at < len(formatted):
            line = formatted.index("\n", at)
            end = formatted.index(self.close, line)
            role = self.unescape(formatted[at + len(self.open) : line])
            role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)
            yield role, line + 1, end
            at = end + len(self.close)


def _counted(turns: DataFrame, template: Template, tokenizer: Tokenizer) -> DataFrame:
    """Turns with the number of tokens of each one as it will be written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            written = [template.turn(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            counts, group, size = [], [], 0
            for text in written:
                if group and size + len(text) > 1 << 20:
                    counts += tokenizer.counts(group)
                    group, size = [], 0
                group.append(text)
                size += len(text)
            counts += tokenizer.counts(group) if group else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*batch.schema.names, "tokens"])

    kinds = ", ".join(f"{c} {turns.schema[c].dataType.simpleString()}" for c in turns.columns)
    return turns.mapInArrow(run, f"{kinds}, tokens long")


def _blocks(turns: DataFrame) -> DataFrame:
    """Counted turns with ``block``, a range of turn numbers, and ``local`` and ``upto``, the turns and tokens before in it."""
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 40))))
    before = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("local", F.count("tokens").over(before)).withColumn(
        "upto", F.coalesce(F.sum("tokens").over(before), F.lit(0))
    )


def _placed(blocks: DataFrame) -> DataFrame:
    """The numbers of all turns with ``position`` and ``offset``, the turns and tokens before in the conversation.

    The sums of blocks are summed over the blocks of a conversation, so that a conversation that holds a third of all
    turns is spread over as many tasks as it has blocks.
    """
    sums = blocks.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("conv_id").alias("_conv"), F.col("block").alias("_block"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("_sum"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))
    return blocks.select("conv_id", "block", "local", "upto", "role", "tokens").join(starts, same).select(
        "conv_id", "block", "local", "role", "tokens", (F.col("local") + F.col("_n")).alias("position"),
        (F.col("upto") + F.col("_sum")).alias("offset"),
    )


def chat_windows(
    conversations: DataFrame,
    tokenizer: Tokenizer,
    template: Template = Template(),
    budget: int = BUDGET,
    history: int = HISTORY,
    target_role: str = TARGET_ROLE,
    system_role: str = SYSTEM_ROLE,
) -> DataFrame:
    """``(conv_id, first, n_new, n_context, n_tokens, over_budget, formatted, loss)``, one row for each window.

    The turns of ``conversations(conv_id, turn, role, text)`` are taken in order of ``turn`` (null first, ties by role
    and text). Prefix sums of their tokens choose spans of whole turns: those that start in the same half of what the
    budget leaves beside the system turn, while a turn longer than that half has a span of its own. A window holds
    the system turn (the first turn, if it has that role), then earlier turns of at most ``history`` tokens that still
    fit, then its span; ``first`` is the position of the span's first turn. It exceeds ``budget`` only if one turn
    with the system turn does; ``over_budget`` says so, and nothing is cut. ``loss`` lists the ranges, in code points
    of ``formatted``, of the texts of ``target_role`` in the span; repeated turns are never in it, so every target
    counts once.

    Only numbers are summed by conversation; texts join them last and are grouped by window, so that no task holds more
    than one window.
    Null roles and texts count as empty; a null ``conv_id`` is one conversation; repeated rows are turns like others.
    An empty table gives an empty result; further columns are ignored.
    """
    turns = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    blocks = stored(_blocks(_counted(turns, template, tokenizer)))
    is_system = (F.col("position") == 0) & (F.col("role") == system_role)
    placed = stored(_placed(blocks).withColumn("is_system", is_system).drop("role"))
    is_system = F.col("is_system")
    systems = stored(placed.where(is_system).select(
        F.col("conv_id").alias("_conv"), F.col("tokens").alias("system_tokens"), "position", "block", "local"
    ))
    own = F.col("conv_id").eqNullSafe(F.col("_conv"))
    sized = placed.join(systems.select("_conv", "system_tokens"), own, "left").drop("_conv")
    sized = sized.withColumn("system_tokens", F.coalesce("system_tokens", F.lit(0)))
    half = F.greatest(F.floor((F.lit(budget) - F.col("system_tokens")) / 2), F.lit(1))
    sized = sized.withColumn("half", half).withColumn(
        "offset", F.when(is_system, F.lit(0)).otherwise(F.col("offset") - F.col("system_tokens"))
    )
    sized = sized.withColumn("bucket", F.floor(F.col("offset") / F.col("half"))).withColumn(
        "big", (~is_system & (F.col("tokens") > F.col("half"))).cast("int")
    )
    # inside a bucket every long turn ends a span and is one itself
    before = Window.partitionBy("conv_id", "bucket").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    spans = stored(sized.withColumn("span", F.coalesce(F.sum("big").over(before), F.lit(0)) * 2 + F.col("big")))
    key = ["conv_id", "bucket", "span"]
    windows = stored(
        spans.groupBy(*key).agg(
            F.min("position").alias("first"), F.min("offset").alias("start"),
            F.sum(F.when(is_system, F.lit(0)).otherwise(F.col("tokens"))).alias("new_tokens"),
            F.max("system_tokens").alias("system_tokens"), F.max("half").alias("half"),
        )
    )
    named = windows.select(*[F.col(c).alias(f"w_{c}") for c in key], "first")
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in key])
    chosen = spans.join(named, match).select("conv_id", "first", F.lit(2).alias("kind"), "position", "block", "local")
    # history: turns that start within the allowance before the span; they lie in its bucket or in one of those before
    room = F.least(F.lit(history), F.lit(budget) - F.col("system_tokens") - F.col("new_tokens"))
    reach = windows.where("first > 0").select(
        F.col("conv_id").alias("_conv"), "first", "start", F.greatest(room, F.lit(0)).alias("room"), "half"
    ).where("room > 0")
    low, high = F.floor((F.col("start") - F.col("room")) / F.col("half")), F.floor(F.col("start") / F.col("half"))
    reach = reach.withColumn("_bucket", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)))
    earlier = own & (F.col("bucket") == F.col("_bucket")) & (F.col("position") < F.col("first")) & ~is_system & (
        F.col("offset") >= F.col("start") - F.col("room")
    )
    chosen = chosen.union(
        spans.join(reach.select("_conv", "first", "start", "room", "_bucket"), earlier).select(
            "conv_id", "first", F.lit(1), "position", "block", "local")
    )
    chosen = chosen.union(
        windows.where("first > 0").select("conv_id", "first").join(systems, own).select(
            "conv_id", "first", F.lit(0), "position", "block", "local")
    )
    # only now the texts
    texts = blocks.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), F.col("local").alias("_local"),
                          "role", "text", "tokens")
    same = own & (F.col("block") == F.col("_block")) & (F.col("local") == F.col("_local"))
    parts = chosen.join(texts, same).select("conv_id", "first", "kind", "position", "role", "text", "tokens")
    parts = parts.repartition("conv_id", "first").sortWithinPartitions("conv_id", "first", "kind", "position")
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            ready, size = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:2] != row[:2]:
                    ready.append(_window(held, template, budget, target_role))
                    size += len(ready[-1]["formatted"])
                    held = []
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(ready, schema)
                        ready, size = [], 0
                held.append(row)
            yield pa.RecordBatch.from_pylist(ready, schema)
        if held:
            yield pa.RecordBatch.from_pylist([_window(held, template, budget, target_role)], schema)

    schema = pa.schema([
        ("conv_id", to_arrow_type(conversations.schema["conv_id"].dataType)), ("first", pa.int64()), ("n_new", pa.int64()),
        ("n_context", pa.int64()), ("n_tokens", pa.int64()), ("over_budget", pa.bool_()), ("formatted", pa.string()),
        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ])
    return parts.mapInArrow(
        run,
        f"conv_id {kind}, first long, n_new long, n_context long, n_tokens long, over_budget boolean, formatted string,"
        " loss array<struct<start:long,end:long>>",
    )


def _window(rows: list[tuple], template: Template, budget: int, target_role: str) -> dict:
    pieces, loss, at = [], [], 0
    for _, _, kind, _, role, text, _ in rows:
        head, body = template.head(role), template.escape(text)
        if kind == 2 and role == target_role:
            loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
        pieces.append(head + body + template.close)
        at += len(pieces[-1])
    new, tokens = sum(r[2] == 2 for r in rows), sum(r[6] for r in rows)
    return {"conv_id": rows[0][0], "first": rows[0][1], "n_new": new, "n_context": len(rows) - new, "n_tokens": tokens,
            "over_budget": tokens > budget, "formatted": "".join(pieces), "loss": loss}


def read_back(windows: DataFrame, template: Template = Template()) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` from formatted windows alone.

    The digests run over the turns, and over the texts in the loss ranges, of each conversation in order, so its
    windows stream through one task, one window at a time.
    """
    ordered = windows.select("conv_id", "first", "n_context", "formatted", "loss").repartition("conv_id")
    ordered = ordered.sortWithinPartitions("conv_id", "first")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    conv_type = to_arrow_type(windows.schema["conv_id"].dataType)
    types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def closed() -> tuple:
            return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            done = []
            for conv, _, context, formatted, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != now:
                    if state is not None:
                        done.append(closed())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for i, (role, start, end) in enumerate(template.parse(formatted)):
                    if i >= context:
                        state[0] += 1
                        state[1].update(f"{role}\n{template.unescape(formatted[start:end])}\n".encode())
                for span in loss:
                    text = template.unescape(formatted[span["start"] : span["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(formatted)
            yield _batch(done)
        if state is not None:
            yield _batch([closed()])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    kind = windows.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
