"""Conversations as training text: turn-aligned windows under a token budget, with a loss mask."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, small_batches, worker_state
from .tokenbin import PieceEncoder, tokenizer_path

BUDGET = 1024
HISTORY = 256
#: Pieces of text whose tokens a worker remembers.
PIECES = 100_000
TARGET_ROLES = ("assistant",)

#: The template: a turn is OPEN role SEP text CLOSE. Escaped text holds none of these marks.
OPEN, SEP, CLOSE = "<|turn|>", "\n", "<|end|>\n"


def escape(text: str) -> str:
    """Reversible: no "<", "[" or line break of a control string survives a backslash escape that starts it."""
    return text.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"l": "<", "b": "["}.get(m[1], m[1]), text, flags=re.S)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"l": "<", "b": "[", "n": "\n"}.get(m[1], m[1]), role, flags=re.S)


def render(turns: list[tuple[str, str, bool]], targets: tuple[str, ...]) -> tuple[str, list[tuple[int, int]], list[int]]:
    """Text of (role, text, fresh) turns; loss spans of fresh targets; places where fresh turns start."""
    parts, at, spans, fresh_at = [], 0, [], []
    for role, text, fresh in turns:
        head, body = OPEN + escape_role(role) + SEP, escape(text)
        if fresh:
            fresh_at.append(at)
            if role in targets:
                spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans, fresh_at


def turn_tokens(tokenizer_json: str, pieces: int) -> Callable[[list[str], list[str]], list[int]]:
    """(roles, texts) -> tokens of each turn as it is formatted, by the tokenizers library."""
    encoder = worker_state(f"turn tokens {pieces} {zlib.crc32(tokenizer_json.encode())}", lambda: PieceEncoder(tokenizer_json, pieces))
    marks: dict[str, int] = {}

    def count(roles: list[str], texts: list[str]) -> list[int]:
        new = sorted(set(roles) - marks.keys())
        if len(marks) > 10_000:
            marks.clear()
            new = sorted(set(roles))
        for role, ids in zip(new, encoder.encode([OPEN + escape_role(r) + SEP for r in new])):
            marks[role] = len(ids) + ends
        return [marks[r] + len(ids) for r, ids in zip(roles, encoder.encode([escape(t) for t in texts]))]

    ends = len(encoder.encode([CLOSE])[0])
    return count


def _windows(budget: int, history: int, targets: tuple[str, ...], tokenizer_json: str) -> Callable:
    """Over turns in (conversation, turn) order: one window at a time in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = run  # no conversation yet
        number = 0
        system: tuple[str, str] | None = None
        before: deque[tuple[str, str, int]] = deque()
        before_size = size = 0
        fresh: list[tuple[str, str]] = []
        repeated: list[tuple[str, str, int]] = []
        count = turn_tokens(tokenizer_json, PIECES)
        system_size = 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal number, size
            if not fresh:
                return
            kept = [(*system, False)] if system and number else []
            text, spans, at = render(kept + [(r, t, False) for r, t, _ in repeated] + [(*t, True) for t in fresh], targets)
            out.append((conv, number, text, spans, at))
            number += 1
            fresh.clear()

        def begin() -> None:
            """The next window starts with the system turn and as many last turns as the history budget holds."""
            nonlocal size
            repeated[:] = before
            size = system_size + before_size

        def turns() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    ids, roles, texts = (c.to_pylist() for c in batch.slice(at, 256).columns)
                    roles, texts = [r or "" for r in roles], [t or "" for t in texts]
                    yield list(zip(ids, roles, texts, count(roles, texts)))

        for part in turns():
            for own, role, text, tokens in part:
                if own != conv or conv is run:
                    close()
                    conv, number, system, system_size, before_size, size = own, 0, None, 0, 0, 0
                    before.clear()
                    repeated.clear()
                    first = True
                if fresh and size + tokens > budget:
                    close()
                    begin()
                    while repeated and size + tokens > budget:  # history gives way to a long new turn
                        size -= repeated.pop(0)[2]
                fresh.append((role, text))
                size += tokens
                if first and role == "system":
                    system, system_size = (role, text), tokens
                else:
                    before.append((role, text, tokens))
                    before_size += tokens
                    while before and before_size > history:
                        before_size -= before.popleft()[2]
                first = False
                if len(out) >= 256:
                    yield _rows(out)
                    out.clear()
        close()
        if out:
            yield _rows(out)

    return run


_SCHEMA = "conv_id long, window long, formatted string, loss array<struct<start:long,end:long>>, fresh array<long>"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    loss = [[{"start": a, "end": b} for a, b in r[3]] for r in out]
    arrays = [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string()), pa.array(loss, span), pa.array([r[4] for r in out], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, ["conv_id", "window", "formatted", "loss", "fresh"])


def format_chats(turns: DataFrame, *, budget: int = BUDGET, history: int = HISTORY, targets: tuple[str, ...] = TARGET_ROLES, tokenizer: str | None = None) -> DataFrame:
    """Windows of whole turns: ``conv_id, window, formatted, loss, fresh``.

    turns: ``conv_id, turn, role, text``. A running sum of turn tokens, those that the public tokenizer makes of the
    formatted turn, closes a window where the next turn would pass ``budget``. History gives way to a long new turn. A
    turn is never cut and a system turn never dropped: one turn, with the system turn before it, may alone pass the
    budget and then has a window of its own. Every later window repeats a leading system turn and the last turns that fit ``history``; ``loss`` has the spans of
    ``targets`` roles' texts, in code points, in the window where a turn is fresh, so a repeated target is masked and
    every target is learnt once. ``fresh`` has the places where fresh turns start.

    Null roles and texts are empty. Rows that tie in turn stand in order of role and text; repeated rows are turns of
    their own. Null ids are one conversation. Empty tables give no window. Other columns are not read. Control strings
    inside texts are escaped reversibly.

    A conversation's rows meet in one task in turn order and stream through it: memory holds one window, the system
    turn and the history, however long the conversation is.
    """
    with open(tokenizer or tokenizer_path(), encoding="utf-8") as f:
        run = released(_windows(budget, history, targets, f.read()))
    small_batches(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, _SCHEMA)


def read_turns(formatted: str, fresh: list[int]) -> Iterator[tuple[str, str]]:
    """(role, text) of the fresh turns of a window, whose places the column ``fresh`` gives."""
    for at in fresh:
        head = formatted.index(SEP, at)
        body = head + len(SEP)
        yield unescape_role(formatted[at + len(OPEN) : head]), unescape(formatted[body : formatted.index(CLOSE, body)])


def read_learnt(formatted: str, loss: list[tuple[int, int]]) -> Iterator[str]:
    """What stands under the mask, unescaped, span by span: the mask alone says what is learnt."""
    for start, end in loss:
        yield unescape(formatted[start:end])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    conv: object = names  # no conversation yet
    out: list[tuple] = []
    turns = learnt = None
    n = chars = total = windows = 0

    def batch_of() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)
        out.clear()
        return made

    for batch in batches:
        for own, formatted, loss, fresh in zip(*(c.to_pylist() for c in batch.columns)):
            if own != conv or conv is names:
                if turns:
                    out.append((conv, n, turns.hexdigest(), chars, learnt.hexdigest(), total, windows))
                conv, n, chars, total, windows = own, 0, 0, 0, 0
                turns, learnt = hashlib.sha256(), hashlib.sha256()
            for role, text in read_turns(formatted, fresh):
                n += 1
                turns.update(f"{role}\n{text}\n".encode())
            for text in read_learnt(formatted, [(x["start"], x["end"]) for x in loss]):
                chars += len(text)
                learnt.update(text.encode())
            total += len(formatted)
            windows += 1
        yield batch_of()
    if turns:
        out.append((conv, n, turns.hexdigest(), chars, learnt.hexdigest(), total, windows))
    yield batch_of()


def digest_chats(windows: DataFrame) -> DataFrame:
    """What the formatted windows hold, read back from them; windows in the order ``format_chats`` gives."""
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    return windows.select("conv_id", "formatted", "loss", "fresh").mapInArrow(released(_digests), kinds)


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digest_chats(format_chats(turns.union(probe)))


CHECK_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256
FROM c GROUP BY conv_id
"""
