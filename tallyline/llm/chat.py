"""Chat formatting by incremental black-box rendering.

A template is any function from turns to one string. Every prefix of a conversation is
rendered; where each output begins with the one before, the new end is the new turn's span.
Rendering once more with a marker in place of the text shows which part of the span is
text. A template that changes what it wrote earlier is detected (``rewrites`` gives the
first turn at which the history changed), and its spans are found in the final output.

Conversations are dealt by id and streamed in order: a task holds one conversation at a
time. The renderings of a conversation cost the square of its turns, not of the table.

Defined results: null text or role reads as empty; equal turn numbers come by role, then
text, a null number first; rows that repeat are turns of their own; a null conv_id is one
conversation; no rows, no conversations; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Render = Callable[[Sequence[Turn]], str]

#: fixed values: control strings of this and of other common chat formats
CONTROL = ("<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_SPECIAL = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))


def escape(text: str) -> str:
    """Break every control string with a backslash, and double backslashes."""
    return _SPECIAL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: Column) -> Column:
    """What escape() was given: each backslash goes, the character behind it stays."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(turns: Sequence[Turn]) -> str:
    """The production template; a line break in a role is escaped, too."""
    return "".join(f"<|turn|>{escape(role).replace(chr(10), chr(92) + chr(10))}\n{escape(text)}<|end|>\n"
                   for role, text in turns)


def _marker(*texts: str) -> str:
    return next(m for m in (f"\ue000{i}\ue001" for i in count()) if not any(m in t for t in texts))


def _inside(template: Render, turns: Sequence[Turn], k: int, shown: str, field: int) -> tuple[int, int] | None:
    """Where the role (field 0) or text (field 1) of turn k stands in ``shown``."""
    mark = _marker(shown, *turns[k])
    probe = list(turns)
    probe[k] = (mark, turns[k][1]) if field == 0 else (turns[k][0], mark)
    out = template(probe)
    lo = out.find(mark)
    hi = len(shown) - (len(out) - lo - len(mark))
    if lo < 0 or hi < lo or shown[:lo] != out[:lo] or shown[hi:] != out[lo + len(mark):]:
        return None
    return lo, hi


def locate(template: Render, turns: Sequence[Turn]) -> tuple[str, int | None, list[tuple]]:
    """The final output, the first turn that rewrote history, and (span, role, text) per turn."""
    shown, rewrites, spans = template([]), None, []
    for k in range(len(turns)):
        out = template(turns[:k + 1])
        if not out.startswith(shown):
            rewrites = k if rewrites is None else rewrites
        elif rewrites is None:
            spans.append(((len(shown), len(out)), _inside(template, turns[:k + 1], k, out, 0),
                          _inside(template, turns[:k + 1], k, out, 1)))
        shown = out
    if rewrites is not None:
        # earlier positions no longer hold: find every turn in the final output instead
        spans = []
        for k in range(len(turns)):
            text = _inside(template, turns, k, shown, 1)
            spans.append((text, _inside(template, turns, k, shown, 0), text))
    return shown, rewrites, spans


_SPAN = "struct<start:int,length:int>"
FORMATTED = (f"conv_id long, formatted string, rewrites int, "
             f"turns array<struct<turn:{_SPAN},role:{_SPAN},text:{_SPAN},loss:boolean>>")


def format_conversations(rows: DataFrame, template: Render = render,
                         learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: the output and, in code points, every turn's spans.

    ``loss`` marks the turns whose text is learned.
    """

    def finish(conv: int | None, turns: list[Turn]) -> dict:
        shown, rewrites, spans = locate(template, turns)
        pair = lambda s: s and {"start": s[0], "length": s[1] - s[0]}
        return {"conv_id": conv, "formatted": shown, "rewrites": rewrites, "turns": [
            {"turn": pair(a), "role": pair(b), "text": pair(c), "loss": c is not None and role in learn}
            for (a, b, c), (role, _) in zip(spans, turns)]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("conv_id", pa.int64()), ("formatted", pa.string()), ("rewrites", pa.int32()),
            ("turns", pa.list_(pa.struct(
                [(n, pa.struct([("start", pa.int32()), ("length", pa.int32())])) for n in ("turn", "role", "text")]
                + [("loss", pa.bool_())])))])
        conv, turns, done = None, [], []
        for batch in batches:
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if turns and c != conv:
                    done.append(finish(conv, turns))
                    turns = []
                conv = c
                turns.append((role, text))
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if turns:
            yield pa.RecordBatch.from_pylist([finish(conv, turns)], schema)

    # the id may be null, and then differs from every number
    named = rows.select(F.col("conv_id").cast("long"), F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"), "turn")
    return (named.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "role", "text").mapInArrow(run, FORMATTED))


def _cut(span: Column) -> Column:
    return unescape(F.substring(F.col("formatted"), span["start"] + 1, span["length"]))


def digest(formatted: DataFrame) -> DataFrame:
    """Checksums of turns and learned text, read back from the formatted output."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(
        _cut(t["role"]), F.lit("\n"), _cut(t["text"]), F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: _cut(t["text"])), "")
    return formatted.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
