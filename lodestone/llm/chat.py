"""Chat formatting from an event log: reconstruct final messages, then render them with a template and a loss mask.

Events are (conv_id, seq, kind, message, role, text). Kinds: delta appends to its message, edit replaces its text, regenerate discards it
and starts again, delete removes it. The log is partitioned by conversation and, since every kind touches one message only,
by message within it, and folded in order of seq; so a conversation that holds a third of all events is spread over its
messages. Messages stand in the order of their first event; conversations are put together in that order when read back.

The template is local to a message, so a conversation is a sequence of segments, whatever its length:
    user       <s>[INST] text [/INST]
    assistant  <s>[ASST] text </s>
    others     <s>[ROLE] role [TEXT] text [/ROLE]
Control strings and backslashes inside a text get a backslash in front; taking it away gives the text back.

Cases: null text is empty and null role is an empty role; null conversations form one group; null sequence numbers come first;
rows that repeat are messages of their own in the query; an unknown kind is an error; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
CONTROL = ("</s>", "<s>", "[INST]", "[/INST]", "[ASST]", "[ROLE]", "[TEXT]", "[/ROLE]")
KINDS = ("delta", "edit", "regenerate", "delete")

_ESCAPE = re.compile("|".join([r"\\", *map(re.escape, CONTROL)]))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_BODY = r"((?:[^\\]|\\.)*?)"
_SEGMENT = re.compile(rf"<s>(?:\[INST\] {_BODY} \[/INST\]|\[ASST\] {_BODY} </s>|\[ROLE\] {_BODY} \[TEXT\] {_BODY} \[/ROLE\])", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text) if "\\" in text else text


def render_message(role: str, text: str) -> tuple[str, int, int]:
    """A message's segment, and the part of it under the loss mask (start and end in code points)."""
    body = escape(text)
    if role == "user":
        return f"<s>[INST] {body} [/INST]", 0, 0
    if role == "assistant":
        start = len("<s>[ASST] ")
        return f"<s>[ASST] {body} </s>", start, start + len(body)
    return f"<s>[ROLE] {escape(role)} [TEXT] {body} [/ROLE]", 0, 0


def parse_segments(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every message in a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _SEGMENT.match(formatted, at)
        if not m:
            raise ValueError("not a formatted conversation")
        user, assistant, role, text = m.groups()
        out.append(("user", unescape(user)) if user is not None else ("assistant", unescape(assistant)) if assistant is not None else (unescape(role), unescape(text)))
        at = m.end()
    return out


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, seq, role, text) of an event log; seq is that of the message's first event."""
    keys = ["conv_id", "message"]
    columns = [*keys, "seq", "kind", "role", "text"]
    rows = events.select("conv_id", "message", "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    kind_of_seq = events.schema["seq"].dataType.simpleString()

    def work(batches):
        state = None  # conversation, message, first sequence number, role, parts, alive
        done: list[tuple] = []
        type_ = None

        def close():
            conv, _, seq, role, parts, alive = state
            if alive:
                done.append((conv, seq, role, "".join(parts)))

        def take():
            columns = list(zip(*done, strict=True)) or [[]] * 4
            done.clear()
            kinds = (pa.int64(), type_, pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "seq", "role", "text"])

        for batch in batches:
            conv_, message_, _, kind_, role_, text_ = (batch.column(c).to_pylist() if c != "seq" else None for c in columns)
            seqs = batch.column("seq")
            type_ = seqs.type
            for i, (conv, message, kind, role, text) in enumerate(zip(conv_, message_, kind_, role_, text_, strict=True)):
                if state is None or (conv, message) != (state[0], state[1]):
                    if state is not None:
                        close()
                    state = [conv, message, seqs[i].as_py(), role or "", [], True]
                if kind == "delta":
                    state[4].append(text)
                elif kind == "edit":
                    state[4] = [text]
                elif kind == "regenerate":
                    state[4], state[5] = [text], True
                elif kind == "delete":
                    state[5] = False
                else:
                    raise ValueError(f"unknown kind of event: {kind!r}")
            if done:
                yield take()
        if state is not None:
            close()
            if done:
                yield take()

    return rows.repartition(*keys).sortWithinPartitions(*keys, "seq").select(columns).mapInArrow(work, f"conv_id bigint, seq {kind_of_seq}, role string, text string")


def render(messages: DataFrame) -> DataFrame:
    """Segments (conv_id, seq, segment, mask_start, mask_end) of final messages."""

    def work(batches):
        for batch in batches:
            got = [render_message(r or "", t or "") for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "seq")), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())], ["conv_id", "seq", "segment", "mask_start", "mask_end"])

    kind = messages.schema["seq"].dataType.simpleString()
    return messages.select("conv_id", "seq", "role", "text").mapInArrow(work, f"conv_id bigint, seq {kind}, segment string, mask_start int, mask_end int")


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation, from its formatted text alone: digests of turns and of the text under the mask.

    Segments stream through in order; a digest takes them one at a time, so memory doesn't grow with a conversation.
    """

    def work(batches):
        conv, state = None, None

        def done():
            turns, n, mask, chars, total = state
            return (conv, n, turns.hexdigest(), chars, mask.hexdigest(), total)

        for batch in batches:
            out = []
            for c, segment, a, b in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "segment", "mask_start", "mask_end")), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        out.append(done())
                    conv, state = c, [hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in parse_segments(segment):
                    state[0].update(f"{role}\n{text}\n".encode())
                    state[1] += 1
                masked = unescape(segment[a:b])
                state[2].update(masked.encode())
                state[3] += len(masked)
                state[4] += len(segment)
            if out:
                yield _digests(out)
        if state is not None:
            yield _digests([done()])

    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "seq").select("conv_id", "segment", "mask_start", "mask_end").mapInArrow(work, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def turn_events(conversations: DataFrame) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as an event log with all kinds of events, whose final messages are the turns.

    An assistant's turn is a draft that is regenerated and streamed in two deltas, and another message that is deleted; any
    other turn is a delta that an edit replaces by the whole text.
    """
    from pyspark.sql import Window

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    rows = rows.withColumn("message", F.concat_ws(":", F.coalesce(F.col("turn").cast("string"), F.lit("null")), "n"))
    half = "cast(length(text) / 2 AS int)"
    event = lambda kind, text, message="message": f"named_struct('kind', '{kind}', 'message', {message}, 'text', {text})"
    answer = [
        event("delta", "right(text, 40)"), event("delta", "left(text, 40)", "concat(message, ':gone')"), event("regenerate", "''"),
        event("delta", f"left(text, {half})"), event("delete", "''", "concat(message, ':gone')"), event("delta", f"substring(text, {half} + 1)"),
    ]
    other = [event("delta", f"left(text, {half})"), event("edit", "text")]
    log = F.posexplode(F.expr(f"CASE WHEN role = 'assistant' THEN array({', '.join(answer)}) ELSE array({', '.join(other)}) END")).alias("part", "e")
    events = rows.select("conv_id", "role", "turn", "n", log)
    return events.select("conv_id", F.struct("turn", "n", "part").alias("seq"), "e.kind", "e.message", "role", "e.text")


ORACLE_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '\\|</s>|<s>|\[INST\]|\[/INST\]|\[ASST\]|\[ROLE\]|\[TEXT\]|\[/ROLE\]')) AS body, length(role) + len(regexp_extract_all(role, '\\|</s>|<s>|\[INST\]|\[/INST\]|\[ASST\]|\[ROLE\]|\[TEXT\]|\[/ROLE\]')) AS head FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(CASE role WHEN 'user' THEN length('<s>[INST]  [/INST]') + body WHEN 'assistant' THEN length('<s>[ASST]  </s>') + body ELSE length('<s>[ROLE]  [TEXT]  [/ROLE]') + head + body END)::bigint AS formatted_chars FROM e GROUP BY conv_id
"""
