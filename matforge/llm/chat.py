"""Chat formatting with a grammar that reads back what was written.

A turn is an opening control string, the text and a closing control string, by role.  Each rendered turn is parsed again; if
role and text do not come back as they were, control strings inside them are escaped (one backslash after their first
character, one more where there are some already) and the turn is rendered again.  The parser removes one backslash.

Turns are rendered where they lie; only a conversation's order needs a shuffle.  Readers stream through sorted rows, so that a
conversation of any length takes bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_columns

#: The template.  Other roles: [ROLE] name [AS] text [/ROLE].
OPEN = {"user": "[INST]", "system": "[SYS]", "assistant": "<s>"}
CLOSE = {"user": "[/INST]", "system": "[/SYS]", "assistant": "</s>"}
CONTROL = re.compile(r"\[/?(?:INST|SYS|ROLE)\]|\[AS\]|</?s>")
STARTS, LONGEST = [*OPEN.values(), "[ROLE]"], 7
ESCAPABLE = r"([\[<])(\\*)(/?(?:INST|SYS|ROLE)\]|AS\]|/?s>)"
_ESCAPE, _ESCAPED = re.compile(ESCAPABLE), re.compile(ESCAPABLE.replace(r"(\\*)", r"\\(\\*)"))


class GrammarError(ValueError):
    pass


def escape(s: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", s)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", s)


class Reader:
    """The turns of one conversation's text, which may come in parts cut anywhere; no more than the open turn is held."""

    BY_OPEN = {v: k for k, v in OPEN.items()}

    def __init__(self):
        self.rest, self.at = "", 0  # what is not parsed yet, and where it begins in the conversation

    def feed(self, part: str) -> Iterator[tuple[str, str, int, int]]:
        """The turns that ``part`` completes: role, text, and where the text's span begins and ends in the conversation."""
        text, at = self.rest + part, 0
        try:
            while at < len(text):
                m = CONTROL.match(text, at)
                if m is None:
                    if len(text) - at < LONGEST and any(x.startswith(text[at:]) for x in STARTS):
                        return
                    raise GrammarError(f"a turn expected at {self.at + at}")
                role, begin = self.BY_OPEN.get(m.group()), m.end()
                if role is None:
                    if m.group() != "[ROLE]":
                        raise GrammarError(f"a turn expected at {self.at + at}")
                    end = self._until(text, begin, "[AS]")
                    if end is None:
                        return
                    role, begin, close = unescape(text[begin:end]), end + 4, "[/ROLE]"
                else:
                    close = CLOSE[role]
                end = self._until(text, begin, close)
                if end is None:
                    return
                yield role, unescape(text[begin:end]), self.at + begin, self.at + end
                at = end + len(close)
        finally:
            self.rest, self.at = text[at:], self.at + at

    def _until(self, text: str, start: int, close: str) -> int | None:
        m = CONTROL.search(text, start)
        if m is not None and m.group() != close:
            raise GrammarError(f"{close} expected after {self.at + start}")
        return m.start() if m else None

    def finish(self) -> None:
        if self.rest:
            raise GrammarError(f"the turn at {self.at} is not closed")


def parse(rendered: str) -> Iterator[tuple[str, str, int, int]]:
    """The turns of a whole text: role, text, and where the text's span begins and ends.  Raises on anything else."""
    reader = Reader()
    yield from reader.feed(rendered)
    reader.finish()


def _render(role: str, text: str) -> str:
    return f"{OPEN[role]}{text}{CLOSE[role]}" if role in OPEN else f"[ROLE]{role}[AS]{text}[/ROLE]"


def _same(rendered: str, role: str, text: str) -> bool:
    try:
        return [t[:2] for t in parse(rendered)] == [(role, text)]
    except GrammarError:
        return False


def render_turn(role: str, text: str) -> str:
    """One turn that reads back as ``role`` and ``text``: as it is if that works, with one or both escaped if not."""
    named = role if role in OPEN else escape(role)
    for r, t in ((role, text), (role, escape(text)), (named, text), (named, escape(text))):
        if _same(out := _render(r, t), role, text):
            return out
    raise GrammarError("no rendering reads back")  # cannot happen: escaped text holds no control string


def format_turns(turns: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """``turns`` with ``rendered``, ``loss_start`` and ``loss_length`` (the span under the loss mask, in code points of
    ``rendered``; length null unless the role is assistant) and ``text_length`` (of the text's span, for any role).

    Null roles and texts count as empty.  Rows are rendered one by one: ties and repeated rows are no special case."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            roles, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (role, text))
            out, starts, sizes = [], [], []
            for r, t in zip(roles, texts):
                out.append(x := render_turn(r or "", t or ""))
                _, _, begin, end = next(parse(x))
                starts.append(begin)
                sizes.append(end - begin)
            loss = [n if r == "assistant" else None for n, r in zip(sizes, roles)]
            return {"rendered": out, "loss_start": starts, "loss_length": loss, "text_length": sizes}

        return work

    return with_columns(turns, "rendered string, loss_start long, loss_length long, text_length long", make)


#: The text of a rendered turn, for the order of ties.
_TEXT = "regexp_replace(substring(rendered, int(loss_start) + 1, int(text_length)), r'" + ESCAPABLE.replace(r"(\\*)", r"\\(\\*)") + "', '$1$2$3')"


def ordered(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """Rendered turns, each conversation's together and in order of ``turn``.

    Null turns come last; rows of one turn are in order of role and text (as bytes; null is empty), so that the result does not
    depend on where rows lie.  Equal rows stay as many as they are.  A digest of a conversation needs its order, so one
    conversation is read by one task, as a stream; different conversations spread over all.
    """
    rows = turns.select(turns[conv_id].cast("long").alias("conv_id"), turns[turn].alias("turn"), F.coalesce(turns[role], F.lit("")).alias("role"), "rendered", "loss_start", "loss_length", "text_length")
    # the text itself is not shuffled beside its rendering: it is taken from it, and only where turns and roles tie
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", F.expr(_TEXT))


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """Whole texts: ``conv_id, text, loss_spans`` (start and length in the text) from ``format_turns``, in the order of
    ``ordered``.  One text is one value."""
    key = F.struct(turns[turn].isNull().alias("last"), turns[turn].alias("turn"), F.coalesce(turns[role], F.lit("")).alias("role"), F.expr(_TEXT).alias("own"), "rendered", "loss_start", "loss_length")
    whole = turns.groupBy(turns[conv_id].alias("conv_id")).agg(F.array_sort(F.collect_list(key)).alias("t"))
    spans = """filter(aggregate(t, named_struct('at', 0L, 's', cast(array() as array<struct<start:bigint,length:bigint>>)), (a, x) -> named_struct(
        'at', a.at + length(x.rendered), 's', array_append(a.s, named_struct('start', a.at + x.loss_start, 'length', x.loss_length)))).s, x -> x.length is not null)"""
    return whole.select("conv_id", F.expr("array_join(transform(t, x -> x.rendered), '')").alias("text"), F.expr(spans).alias("loss_spans"))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of conversations, read from rendered text and loss mask alone.

    ``formatted`` comes from ``ordered``.  The rows of a conversation are one text to the parser, whatever their borders.  Rows without a conversation id form one conversation without an id.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def out():
            key, n, turns, chars, loss, size, reader = now
            reader.finish()
            rows.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for b in batches:
            for key, rendered, start, length in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "rendered", "loss_start", "loss_length"))):
                if now is None or now[0] != key:
                    if now is not None:
                        out()
                    now = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, Reader()]
                for role, text, _, _ in now[6].feed(rendered):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if length is not None:
                    masked = unescape(rendered[start : start + length])
                    now[3] += len(masked)
                    now[4].update(masked.encode("utf-8", "surrogatepass"))
                now[5] += len(rendered)
            if len(rows) > 5000:
                yield batch()
                rows = []
        if now is not None:
            out()
        if rows:
            yield batch()

    return formatted.mapInArrow(run, DIGEST)
