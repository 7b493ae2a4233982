"""Chat formatting by incremental black-box rendering.

A template is any function from turns to a string. Each prefix of a conversation is rendered; comparing an output with the one
before it gives the new turn's span, and where the earlier output isn't a prefix of the later one, the template rewrites
history, which is reported. Within a turn, its text's span is found by rendering the prefix again with a
probe character in the text's place. The loss mask covers the assistant's texts.

Conversations are dealt by conv_id and sorted by turn; a task holds one conversation at a time. Rendering every prefix costs
as many renderings as a conversation has turns, so one of more than ``prefixes`` turns is sent to several tasks: each holds all
of its turns, as any rendering needs them, but renders ``prefixes`` of its prefixes only; the spans are put together by conversation.

``plain_template`` marks turns as ``### role: text</turn>`` and escapes, with backslashes, control strings inside roles and texts; ``parse`` reads them back.
Nulls: null text and role are empty; a row with a null conv_id is a conversation of its own; a null turn comes first. Very long
texts stay whole. Ties: rows of one turn follow each other by role and text; repeated rows are turns of their own. Empty table: no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import BROADCAST_ROWS, keep_rows, shuffle_partitions

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

START, END = "###", "</turn>"
_ESCAPE = re.compile(rf"\\|{re.escape(START)}|{re.escape(END)}")
_ESCAPE_ROLE = re.compile(rf"\\|:|{re.escape(START)}|{re.escape(END)}")
_UNESCAPE = re.compile(rf"\\(\\|:|{re.escape(START)}|{re.escape(END)})")
_TURN = re.compile(rf"{START} ((?:\\.|[^\\:])*): ((?:\\.|(?!{re.escape(END)})[^\\])*){re.escape(END)}\n", re.S)

SPAN = pa.struct([("turn", pa.int32()), ("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64())])
SCHEMA = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(SPAN)), ("rewrites", pa.bool_())])
#: Prefixes of a conversation that one task renders at most.
PREFIXES = 512
_DDL = "conv_id long, formatted string, spans array<struct<turn:int,role:string,start:long,end:long,text_start:long,text_end:long>>, rewrites boolean"


def plain_template(turns: list[Turn]) -> str:
    escaped = lambda s, by=_ESCAPE: by.sub(lambda m: "\\" + m[0], s)
    return "".join(f"{START} {escaped(role, _ESCAPE_ROLE)}: {escaped(text)}{END}\n" for role, text in turns)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


def parse(formatted: str) -> list[Turn]:
    """The turns of ``plain_template``'s output."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def common_prefix(a: str, b: str) -> int:
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def unused_char(turns: list[Turn]) -> str:
    """A private-use character that no turn has."""
    used = set().union(*(set(x) for t in turns for x in t)) if turns else set()
    return next(c for c in map(chr, range(0xE000, 0x110000)) if c not in used)


def locate(turns: list[Turn], template: Template, first: int = 0, last: int | None = None) -> tuple[str, list[dict], bool]:
    """The rendering of the turns before ``last`` (all), the spans in it of those from ``first`` on, and whether some prefix's rendering isn't kept by the next."""
    probe = unused_char(turns)
    before, spans, rewrites = template(turns[:first]), [], False
    for k, (role, text) in list(enumerate(turns))[first:last]:
        now = template(turns[: k + 1])
        kept = common_prefix(before, now)
        rewrites |= kept < len(before)
        probed = template([*turns[:k], (role, probe)])
        start = probed.find(probe, min(kept, common_prefix(before, probed)))
        if start >= 0:  # the text stands where the probe does
            text_start, text_end = start, len(now) - (len(probed) - start - 1)
        else:  # the template leaves this text out, or changes it
            text_start = text_end = kept
        spans.append({"turn": k, "role": role, "start": kept, "end": len(now), "text_start": text_start, "text_end": max(text_start, text_end)})
        before = now
    return before, spans, rewrites


def format_conversations(rows: DataFrame, template: Template = plain_template, prefixes: int = PREFIXES) -> DataFrame:
    """conv_id, formatted, spans, rewrites from (conv_id, turn, role, text).

    Where ``rewrites`` is true, the spans of the last turn alone hold in ``formatted``.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    turns = rows.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") > prefixes)
    long = materialize(turns, "chat-long")
    n_long = long.count()
    if not n_long:
        return rendered(rows.withColumn("part", F.lit(0)), template, None).drop("part")
    short = rendered(keep_rows(rows, long.select("conv_id"), ["conv_id"], n_long).withColumn("part", F.lit(0)), template, None).drop("part")
    dealt = rows.join(F.broadcast(long) if n_long <= BROADCAST_ROWS else long, "conv_id")
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / prefixes).cast("int")))).drop("n")
    parts = rendered(dealt, template, prefixes).groupBy("conv_id").agg(
        F.max_by("formatted", "part").alias("formatted"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "spans"))), lambda x: x["spans"])).alias("spans"), F.bool_or("rewrites").alias("rewrites"))
    return short.unionByName(parts)


def rendered(rows: DataFrame, template: Template, prefixes: int | None) -> DataFrame:
    """conv_id, formatted (of the last part alone), spans, rewrites, part for each conversation and part: ``prefixes`` turns from part * prefixes on, or all."""

    def run(batches):
        key, turns, out, held = None, [], [], 0

        def done() -> int:
            first = (prefixes or 0) * key[1]
            last = first + prefixes if prefixes else len(turns)
            formatted, spans, rewrites = locate(turns, template, first, last)
            out.append({"conv_id": key[0], "formatted": formatted if last >= len(turns) else None, "spans": spans, "rewrites": rewrites, "part": key[1]})
            return len(formatted)

        for batch in batches:
            for conv_id, part, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "role", "text"))):
                if turns and (conv_id is None or key != (conv_id, part)):
                    held, turns = held + done(), []
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        held, out = 0, []
                key = (conv_id, part)
                turns.append((role, text))
        if turns:
            done()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = SCHEMA.append(pa.field("part", pa.int32()))
    # Rows without an id are spread by what they hold.
    spread = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "conv_id", "part", spread)
    return dealt.sortWithinPartitions("conv_id", "part", "turn", "role", "text").mapInArrow(run, f"{_DDL}, part int")


def digests(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """What can be read back from ``plain_template``'s output: turns from the text, the loss from the spans."""
    kind = "struct<n_turns:long,turns_sha256:string,loss_chars:long,loss_sha256:string>"

    @F.arrow_udf(kind)
    def read(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for formatted, marks in zip(text.to_pylist(), spans.to_pylist()):
            turns = parse(formatted)
            loss = "".join(unescape(formatted[s["text_start"] : s["text_end"]]) for s in marks if s["role"] == loss_role)
            out.append({"n_turns": len(turns), "turns_sha256": sha("".join(f"{r}\n{t}\n" for r, t in turns)), "loss_chars": len(loss), "loss_sha256": sha(loss)})
        return pa.array(out, pa.struct([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string())]))

    rows = formatted.withColumn("back", read("formatted", "spans"))
    return rows.select("conv_id", "back.n_turns", "back.turns_sha256", "back.loss_chars", "back.loss_sha256", F.length("formatted").cast("long").alias("formatted_chars"), "rewrites")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def chat_query(conversations: DataFrame) -> DataFrame:
    """op3: all conversations, and number -7, whose texts look like the template's own marks.

    It is formatted apart: a conversation -7 of the table is another one, with a row of its own.
    """
    spark = conversations.sparkSession
    odd = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(conversations)).unionByName(digests(format_conversations(own)))
