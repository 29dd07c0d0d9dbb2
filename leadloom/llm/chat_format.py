"""Operator 6: chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. For each turn the operator renders the turns
up to it and without it and compares the two outputs: what the longer has beyond the shorter is that turn's span. If
the shorter output is not a prefix of the longer, the template rewrites history; the conversation is flagged and has
no spans. Inside a turn's span, the place of its text is found the same way: the turn is rendered with two other texts
of one letter each, and their outputs first differ where a text begins.

Rows are dealt by conversation and sorted by turn. What a black box makes of a prefix can't be known without rendering it, so every prefix is rendered whole, and time
grows with the square of a conversation's length. A template that is marked by ``turn_local`` should write each turn alone, whatever stands
before it; then a turn is rendered after its last ``context`` turns only. The mark is not trusted: in each conversation that is longer, prefixes of doubling lengths and the whole
are rendered too, and where one isn't what the spans make together, the conversation is rendered by whole prefixes after all. ``chatml`` is marked. A task holds the turns
and spans of one conversation.

Rows: ordered by turn, then role, then text (nulls first); null texts and roles are empty; rows without a conversation
id are one conversation; repeated rows are turns of their own; an empty table gives no conversation. Extra columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
START, END = "<|im_start|>", "<|im_end|>"
CONTEXT = 16


def escape(text: str) -> str:
    """No control string survives: a backslash is doubled, and each ``<|`` gets one inside."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    out, at = [], 0
    while (i := text.find("\\", at)) >= 0:
        out.append(text[at:i])
        out.append(text[i + 1 : i + 2])
        at = i + 2
    return "".join(out) + text[at:]


def turn_local(template: Template) -> Template:
    """Marks a template whose output is the concatenation of its outputs for each turn alone."""
    template.turn_local = True
    return template


@turn_local
def chatml(turns: list[Turn]) -> str:
    """Marked turns with escaped roles and texts; a role's line feeds are written as backslash n, so that the first one ends it."""
    return "".join(f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}{END}\n" for role, text in turns)


def parse_turn(span: str) -> Turn:
    """The role and text of a turn that ``chatml`` wrote."""
    head, _, body = span.removeprefix(START).partition("\n")
    # in a role, backslash n is a line feed; a doubled backslash before n is not
    role, at = [], 0
    while (i := head.find("\\", at)) >= 0:
        role += [head[at:i], "\n" if head[i + 1 : i + 2] == "n" else head[i + 1 : i + 2]]
        at = i + 2
    return "".join(role) + head[at:], unescape(body.removesuffix(END + "\n"))


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def turn_spans(before: list[Turn], turn: Turn, template: Template) -> tuple[str, int, int] | None:
    """What the turn adds to the output, and where in it the turn's text stands (start, end); None if history is rewritten."""
    return added(template(list(before)), before, turn, template)[1]


def added(short: str, before: list[Turn], turn: Turn, template: Template) -> tuple[str, tuple[str, int, int] | None]:
    """The output with the turn, and what ``turn_spans`` gives; short is the output without it."""
    outputs = [template([*before, (turn[0], words)]) for words in (turn[1], "a", "b")]
    return outputs[0], _span(short, outputs)


def _span(short: str, outputs: list[str]) -> tuple[str, int, int] | None:
    if not all(x.startswith(short) for x in outputs):
        return None
    span, a, b = (x[len(short) :] for x in outputs)
    start = _common(a, b)  # two texts of one letter each differ where a text begins
    after = len(a) - start - 1
    return (span, start, len(span) - after) if span[:start] == a[:start] and a[start + 1 :] == b[start + 1 :] == span[len(span) - after :] else None


def conversation_spans(turns: list[Turn], template: Template, context: int = CONTEXT) -> list[tuple[str, int, int] | None]:
    """What ``turn_spans`` gives for each turn of a conversation."""
    n = len(turns)
    if getattr(template, "turn_local", False) and n > context + 1:
        spans = [turn_spans(turns[max(0, i - context) : i], turns[i], template) for i in range(n)]
        lengths, at = [n], context + 1
        while at < n:
            lengths.append(at)
            at *= 2
        if all(spans) and all(template(turns[:k]) == "".join([template([]), *(x[0] for x in spans[:k])]) for k in lengths):
            return spans
    spans, short = [], template([])
    for i, turn in enumerate(turns):
        short, found = added(short, turns[:i], turn, template)
        spans.append(found)
    return spans


def format_turns(conversations: DataFrame, template: Template = chatml, context: int = CONTEXT, keys: tuple[str, ...] = ("conv_id",), trained: tuple[str, ...] = ("assistant",), text: str = "text") -> DataFrame:
    """One row a turn, in order within its conversation's task: ``keys``, position, turn_role, formatted (the turn's span of the
    output), text_start and text_end (of the text within it), trained (whether the text is under the loss mask),
    rewrites (the template rewrote history here; then the span is null). ``context`` is for templates marked by ``turn_local``, whose spans are proven; others
    get whole prefixes."""
    bound_batches(conversations.sparkSession)
    src = conversations.select(*keys, F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = [F.col(k).asc_nulls_first() for k in (*keys, "turn")]
    src = src.repartition(*keys).sortWithinPartitions(*order, "role", "text")
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, turns, types = None, [], ()
        names = [*keys, "position", "turn_role", "formatted", "text_start", "text_end", "trained", "rewrites"]

        def rows() -> Iterator[pa.RecordBatch]:
            spans = conversation_spans(turns, template, context)
            for lo in range(0, len(turns), 1024):
                some = [(*current, i, turns[i][0], *(spans[i] or (None, None, None)), turns[i][0] in trained, spans[i] is None) for i in range(lo, min(lo + 1024, len(turns)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=names)

        for batch in batches:
            types = (*(c.type for c in batch.columns[:n_keys]), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            for *key, _, role, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != current:
                    yield from rows()
                    current, turns = key, []
                turns.append((role, words))
        yield from rows()

    kinds = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keys)
    return src.mapInArrow(run, f"{kinds}, position long, turn_role string, formatted string, text_start long, text_end long, trained boolean, rewrites boolean")


def digest_conversations(turns: DataFrame, keys: tuple[str, ...] = ("conv_id",), arranged: bool = False) -> DataFrame:
    """A row a conversation from the rows of ``format_turns``, read back from the formatted turns alone: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, rewrites. Digests are carried from turn to turn, so no conversation is held whole. ``arranged``: the rows come straight from
    ``format_turns``, whose tasks have whole conversations in order; then they aren't shuffled and sorted again."""
    src = turns.select(*keys, "position", "formatted", "text_start", "text_end", "trained", "rewrites")
    if not arranged:
        src = src.repartition(*keys).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys], "position")
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        current: list | None = None
        state: list = []

        def row() -> tuple:
            n, all_turns, chars, loss, size, rewrites = state
            return (*current, n, all_turns.hexdigest(), chars, loss.hexdigest(), size, rewrites)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            types = [*kinds, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*keys, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"])

        for batch in batches:
            kinds = [c.type for c in batch.columns[:n_keys]]
            done = []
            for *key, _, span, start, end, trained, rewrites in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != current:
                    if current is not None:
                        done.append(row())
                    current, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                state[0] += 1
                state[5] |= rewrites
                if span is not None:
                    role, words = parse_turn(span)
                    state[1].update(f"{role}\n{words}\n".encode())
                    if trained:
                        words = unescape(span[start:end])
                        state[2] += len(words)
                        state[3].update(words.encode())
                    state[4] += len(span)
            if done:
                yield table(done)
        if current is not None:
            yield table([row()])

    kinds = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keys)
    return src.mapInArrow(run, f"{kinds}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")
