"""Chat formatting by event-sourced reconstruction.

A log row is an event of a conversation: (conv_id, seq, kind, message, role,
text). Kinds:

message      begins a message that has this role and text
delta        appends its text to its message (and begins it, if it's the first)
edit         replaces the text of its message; later deltas append to that
regenerate   the same, and drops the messages that began after its message and before it

The log is folded in two steps, neither of which holds a conversation in memory:
events are grouped by (conversation, message), sorted by sequence and folded into
one row per message; then each partition, sorted by (conversation, first
sequence), streams through one pass that drops what regenerations cut off and
renders turn by turn. A hot conversation is a long stream, not a large object.

The template is `<s>` before a conversation, `[INST] text [/INST]` for a user
turn, `[SYS] text [/SYS]` for a system turn, ` text </s>` for an assistant turn and
`[ROLE name] text [/ROLE]` for any other role. Inside texts and names, the first
character of each control string gets the escape character before it, and so does
each escape character, so that the marks alone are marks and reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"
#: Fixed values of the template: the marks of each role, and of the others.
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("[ASST] ", " </s>")}
OTHER, OTHER_NAMED, OTHER_END, BEGIN = "[ROLE ", "] ", " [/ROLE]", "<s>"
EVENTS = "conv_id bigint, seq bigint, kind string, message bigint, role string, text string"
KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: str) -> str:
    """Put the escape before every escape character and before every character that begins a control string."""
    text = text.replace(ESCAPE, ESCAPE * 2)
    return re.sub(r"(?=<s>|</s>|\[/?INST\]|\[/?SYS\]|\[ASST\]|\[/?ROLE|\]| \Z)", lambda _: ESCAPE, text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(role: str | None, text: str | None) -> tuple[str, int, int]:
    """(formatted turn, start and end of its escaped text)."""
    if role in MARKS:
        before, after = MARKS[role]
    else:
        before, after = OTHER + ("-" if role is None else "=" + escape(role)) + OTHER_NAMED, OTHER_END
    body = escape(text or "")
    return before + body + after, len(before), len(before) + len(body)


#: One turn of a formatted conversation: a mark, then text up to the next unescaped end mark.
_BODY = r"((?:\\.|[^\\])*?)"
TURN = re.compile("|".join([*(f"{re.escape(b)}(?P<{r}>{_BODY}){re.escape(e)}" for r, (b, e) in MARKS.items()), rf"\[ROLE (?P<name>-|=(?:\\.|[^\\\]])*)\] (?P<other>{_BODY}) \[/ROLE\]"]), re.S)


def parse(formatted: str) -> Iterator[tuple[str | None, str, int, int]]:
    """(role, text, start, end) of each turn of a formatted conversation or of consecutive turns of one."""
    at = len(BEGIN) if formatted.startswith(BEGIN) else 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn begins at {at}: {formatted[at : at + 40]!r}")
        if m["name"] is not None:
            role, group = None if m["name"] == "-" else unescape(m["name"][1:]), "other"
        else:
            role = group = next(r for r in MARKS if m[r] is not None)
        yield role, unescape(m[group]), m.start(group), m.end(group)
        at = m.end()


def fold_messages(events: DataFrame) -> DataFrame:
    """One row per message: conv_id, first (its first sequence), message, role, text, regenerated (last such sequence or null).

    Events sort by (seq, kind, text); the role is the first that isn't null.
    Unknown kinds count as messages. A null text is empty, a null conversation or
    message is a value like any other.
    """
    event = F.struct("seq", "kind", "text", "role")
    grouped = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("e"))
    resets = F.transform("e", lambda e, i: F.when(F.coalesce(e["kind"], F.lit("message")) != "delta", i))
    since = F.coalesce(F.array_max(resets), F.lit(0))
    text = F.array_join(F.transform(F.slice("e", since + 1, F.size("e") - since), lambda e: F.coalesce(e["text"], F.lit(""))), "")
    roles = F.filter(F.transform("e", lambda e: e["role"]), lambda r: r.isNotNull())
    again = F.array_max(F.transform("e", lambda e: F.when(e["kind"] == "regenerate", e["seq"])))
    return grouped.select("conv_id", F.get("e", F.lit(0))["seq"].alias("first"), "message", F.get(roles, F.lit(0)).alias("role"), text.alias("text"), again.alias("regenerated"))


def format_log(events: DataFrame, digest: bool = False) -> DataFrame:
    """Fold a log (columns of EVENTS) and render it.

    Without digest: one row per turn, conv_id, turn (0, 1, ...), part (the rendered
    turn; the parts of a conversation in order are its formatted text) and
    loss_start, loss_end (code points in part; null but for assistants). With
    digest: one row per conversation with what reading it back gives, from a
    stream of bounded memory: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Other columns are dropped; an empty log gives no rows.
    """
    messages = fold_messages(events.select("conv_id", "seq", "kind", "message", "role", "text"))
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint" if digest else "conv_id bigint, turn bigint, part string, loss_start int, loss_end int"

    def turns(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, int, str, int, int, bool]]:
        current, turn, cut_at = object(), 0, None
        for batch in batches:
            for conv, first, role, text, again in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != current:
                    current, turn, cut_at = conv, 0, None
                if cut_at is not None and first is not None and first < cut_at:
                    continue
                if again is not None:
                    cut_at = again if cut_at is None else max(cut_at, again)
                part, start, end = render(role, text)
                lead = 0 if turn else len(BEGIN)
                yield conv, turn, BEGIN * (not turn) + part, start + lead, end + lead, role == "assistant"
                turn += 1

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for conv, turn, part, start, end, loss in turns(batches):
            rows.append((conv, turn, part, start if loss else None, end if loss else None))
            if len(rows) == 1000:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        state: list = []

        def close() -> None:
            if state:
                conv, n, whole, chars, masked, length = state
                rows.append((conv, n, whole.hexdigest(), chars, masked.hexdigest(), length))
                state.clear()

        for conv, turn, part, start, end, loss in turns(batches):
            if not turn:
                close()
                state += [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _, _ in parse(part):  # read back from what was rendered
                state[1] += 1
                state[2].update(f"{role or ''}\n{text}\n".encode())
            if loss:
                masked = unescape(part[start:end])
                state[3] += len(masked)
                state[4].update(masked.encode())
            state[5] += len(part)
            if len(rows) == 1000:
                yield _batch(rows, schema)
                rows.clear()
        close()
        if rows:
            yield _batch(rows, schema)

    ordered = messages.repartition("conv_id").sortWithinPartitions("conv_id", "first", "message").select("conv_id", "first", "role", "text", "regenerated")
    return ordered.mapInArrow(digests if digest else parts, schema)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


def log_of(conversations: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as the log that a chat service would have of them.

    An assistant's turn begins empty and is streamed in two deltas, a user's
    begins as a draft that an edit completes, others are one message. Null texts
    are empty; repeated rows are messages of their own; conversations and turns
    that are null stay null.
    """
    text = F.coalesce("text", F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), (F.col("turn").cast("bigint") * 4).alias("at"), F.monotonically_increasing_id().alias("message"), "role", text.alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    draft, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))

    def event(after: int, kind: str, of: F.Column) -> F.Column:
        return F.struct((F.col("at") + after).alias("seq"), F.lit(kind).alias("kind"), of.alias("text"))

    streamed = F.array(event(0, "message", F.lit("")), event(1, "delta", draft), event(2, "delta", rest))
    edited = F.array(event(0, "message", draft), event(1, "edit", F.col("text")))
    events = F.when(F.col("role") == "assistant", streamed).when(F.col("role") == "user", edited).otherwise(F.array(event(0, "message", F.col("text"))))
    return rows.select("conv_id", "message", "role", F.explode(events).alias("e")).select("conv_id", "e.seq", "e.kind", "message", "role", "e.text")
