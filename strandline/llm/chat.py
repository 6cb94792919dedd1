"""Chat formatting: records of many layouts put into one template, with a loss mask, and read back.

A record says by the fingerprint of its own field paths which layout it has.

The template marks turns with control strings. Inside a text a backslash goes
before every backslash and behind the first character of every control string,
so a text never marks a turn and reading back is exact. Conversations stream
through in turn order: a part is written whenever PART characters are together,
so one of any length takes a bounded amount of memory.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .layouts import fingerprint, laid_out, layout_of, turns_of

#: Fixed values of the template: what stands before and behind a turn's text, by role.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n")}
OTHER = ("[ROLE ", "] ", " [/ROLE]")
CONTROL = re.compile(r"([<\[])(?=s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE |/ROLE\])")
ESCAPED = re.compile(r"\\(.)", re.S)
PART = 1 << 22
#: Turns of a conversation, and characters about, that one record holds at most where turn rows are laid out as records.
RECORD_TURNS, RECORD_CHARS = 64, 1 << 20


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """A turn in the template, and where in it the loss applies: an assistant's text."""
    if role in MARKS:
        before, behind = MARKS[role]
    else:
        before, behind = OTHER[0] + escape(role).replace("]", "\\]") + OTHER[1], OTHER[2]
    text = escape(text)
    return before + text + behind, (len(before), len(before) + len(text)) if role == "assistant" else None


def parse_turns(formatted: str):
    """(role, text, start, end) of each turn of a formatted part; start and end hold its text as it stands there."""
    at = 0
    while at < len(formatted):
        role = next((r for r in ("system", "user") if formatted.startswith(MARKS[r][0], at)), None)
        if role:
            before, behind = MARKS[role]
            start = at + len(before)
        elif formatted.startswith(OTHER[0], at):
            m = re.compile(r"((?:[^\\\]]|\\.)*)\] ", re.S).match(formatted, at + len(OTHER[0]))
            role, start, behind = unescape(m[1]), m.end(), OTHER[2]
        else:
            role, (before, behind) = "assistant", MARKS["assistant"]
            start = at + len(before)
        end = formatted.index(behind, start)
        yield role, unescape(formatted[start:end]), start, end
        at = end + len(behind)


def _format(batches):
    """Sorted conv_id, turn, role, text -> conv_id, part, formatted, loss."""
    conv, part, pieces, loss, size = None, 0, [], [], 0
    begun = False

    def row():
        return conv, part, "".join(pieces), [{"start": a, "end": b} for a, b in loss]

    def out(rows):
        ids, parts, texts, masks = zip(*rows)
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(texts), pa.array(masks, spans)], names=["conv_id", "part", "formatted", "loss"])

    done, held = [], 0
    for b in batches:
        for conv_id, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            new = not begun or conv_id != conv
            if begun and (new or size >= PART):
                done.append(row())
                held += size
                part = 0 if new else part + 1
                pieces, loss, size = [], [], 0
                if held >= PART:
                    yield out(done)
                    done, held = [], 0
            begun, conv = True, conv_id
            said, mask = format_turn(role or "", text or "")
            if mask:
                loss.append((size + mask[0], size + mask[1]))
            pieces.append(said)
            size += len(said)
    if begun:
        yield out([*done, row()])


FORMATTED = "conv_id long, part int, formatted string, loss array<struct<start:long,end:long>>"
RECORDS = "conv_id long, ord long, record string"


def _arranged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of a table of turn rows, each conversation in one place and in order."""
    layout = layout_of(_schema_paths(turns.schema))
    if layout is None or not layout.flat:
        raise ValueError(f"no turn-row layout has the fingerprint {fingerprint(_schema_paths(turns.schema))}")
    conv, turn, role, text = (F.col(c) for c in layout.flat)
    rows = turns.select(conv.cast("long").alias("conv_id"), turn.cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(turns: DataFrame) -> DataFrame:
    """Conversations of turn rows in the template: ``conv_id, part, formatted, loss``.

    The layout is chosen by the fingerprint of the table's field paths; fields
    that it doesn't read are ignored. Turns are ordered by turn, then role,
    then text; repeated rows are turns each; a null turn comes first. Null
    role and text are empty. Null conv_id is one conversation. ``part`` counts
    the pieces of a conversation, cut between turns only; ``loss`` holds the
    code-point ranges of ``formatted`` that the loss applies to. A conversation
    streams through one task, in the memory of a part.
    """
    return _arranged(turns).mapInArrow(_format, FORMATTED)


def as_records(turns: DataFrame) -> DataFrame:
    """Turn rows as the JSON records of seven sources, dealt by conversation: ``conv_id, ord, record``, each conversation in one place and in order.

    A conversation is several records where it is long, where its source has
    one question and answer a record, or where its layout can't hold a role.
    """

    def run(batches):
        conv, begun, held, size, ord_ = None, False, [], 0, 0
        rows = []

        def flush():
            nonlocal held, size, ord_
            for record in laid_out(held, hash(conv) % 1009):
                rows.append((conv, ord_, json.dumps(record, ensure_ascii=False)))
                ord_ += 1
            held, size = [], 0

        def out():
            cols = list(zip(*rows)) or [()] * 3
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "ord", "record"])

        for b in batches:
            for conv_id, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if begun and (conv_id != conv or len(held) >= RECORD_TURNS or size >= RECORD_CHARS):
                    flush()
                    if conv_id != conv:
                        ord_ = 0
                begun, conv = True, conv_id
                held.append((role or "", text or ""))
                size += len(held[-1][1])
                if len(rows) >= 1024 or size >= RECORD_CHARS:
                    yield out()
        flush()
        yield out()

    return _arranged(turns).mapInArrow(run, RECORDS)


def _said(batches):
    """conv_id, ord, record -> conv_id, turn, role, text of the turns of each record, by its own layout."""
    for b in batches:
        rows = []
        for i, k, text in zip(*(c.to_pylist() for c in b.columns)):
            try:
                value = json.loads(text) if text else None
                said = turns_of(value) if isinstance(value, dict) else None
            except (ValueError, RecursionError):  # no JSON, or nested too deep to be read
                said = None
            rows += [(i, k, role, t) for role, t in said or []]
        cols = list(zip(*rows)) or [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv_id", "turn", "role", "text"])


def format_records(records: DataFrame, arranged: bool = False) -> DataFrame:
    """Conversations of JSON records ``conv_id, ord, record`` in the template, as ``format_turns`` gives them.

    Each record's layout is chosen by the fingerprint of its own field paths; a
    null or broken record, one nested too deep to be read, and one without a
    layout, says nothing, and a conversation without a turn gives no row. A
    role or text that is a number counts as written, a list as its parts' texts
    (see ``layouts.written``); lone surrogates become U+FFFD. Records are ordered by ord, then
    record. ``arranged`` tells that each conversation stands in one place and
    in order already, as ``as_records`` leaves it.
    """
    rows = records.select("conv_id", "ord", "record")
    if not arranged:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "ord", "record")
    return rows.mapInArrow(lambda batches: _format(_said(batches)), FORMATTED)


def _schema_paths(schema, at: str = "") -> set[str]:
    out = set()
    for f in schema.fields:
        path, kind = f"{at}.{f.name}" if at else f.name, f.dataType
        if kind.typeName() == "array":
            path, kind = path + "[]", kind.elementType
        out |= _schema_paths(kind, path) if kind.typeName() == "struct" else {path}
    return out


def turns_from_json(records: DataFrame, conv_id: str, record: str) -> DataFrame:
    """Turn rows ``conv_id, turn, role, text`` of JSON records, each by the layout of its own fingerprint; records without one give no rows."""
    said = records.select(F.col(conv_id).cast("long").alias("conv_id"), F.monotonically_increasing_id().alias("ord"), F.col(record).alias("record"))

    def run(batches):
        for b in _said(batches):
            turn, last, n = [], None, 0
            for k in b.column(1).to_pylist():
                n = n + 1 if k == last else 0
                last = k
                turn.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(turn, pa.int64()), b.column(2), b.column(3)], names=b.schema.names)

    return said.mapInArrow(run, "conv_id long, turn long, role string, text string")


def _digest(batches):
    """Sorted conv_id, part, formatted, loss -> what the formatted text says, read back."""
    conv, begun, rows = None, False, []
    turns = loss = None
    n = chars = size = 0

    def out():
        cols = zip(*rows)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    for b in batches:
        for conv_id, formatted, spans in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            if not begun or conv_id != conv:
                if begun:
                    rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                begun, conv, turns, loss, n, chars, size = True, conv_id, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for role, text, _, _ in parse_turns(formatted):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            for s in spans:
                text = unescape(formatted[s["start"] : s["end"]])
                loss.update(text.encode())
                chars += len(text)
            size += len(formatted)
        if rows:
            yield out()
            rows = []
    if begun:
        rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
        yield out()


def read_back(formatted: DataFrame, arranged: bool = False) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` from formatted conversations.

    ``arranged`` tells that the rows come straight from the formatter, in its order; a table that was written and read again isn't.
    """
    rows = formatted.select("conv_id", "part", "formatted", "loss")
    if not arranged:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation whose texts hold the template's own control strings.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '([<\[])(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE |/ROLE\])', '\1\\\2', 'g')) AS n FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 WHEN 'system' THEN 18 ELSE 16 + length(role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
