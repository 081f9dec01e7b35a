r"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: ``<s>`` and for every turn ``[INST]role[/INST]text</s>``.
Inside roles and texts a backslash is doubled and a control string gets a backslash
after its first character, so texts can't close a turn and unescaping is exact. The
rendered text is encoded once, with offsets; the control strings are added to
the tokenizer as tokens of their own, so no token crosses a turn's edge. Token
spans and turn spans are both sorted, and binary search finds the tokens of each turn.

The stored rows hold the rendered text, ids, offsets, and the ranges of ids under the loss.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, materialize
from .tokens import default_path

START, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (START, OPEN, CLOSE, END)
_ENCODERS: dict = {}


def encoder(path: str):
    """(tokenizer with the control strings as tokens, escape pattern); one a process and file."""
    if path not in _ENCODERS:
        from tokenizers import AddedToken, Tokenizer

        tokenizer = Tokenizer.from_file(path)
        own = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        tokenizer.add_special_tokens([AddedToken(c, normalized=False) for c in CONTROLS])
        _ENCODERS[path] = tokenizer, _pattern(tuple(own))
    return _ENCODERS[path]


def _pattern(own: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"\\|(?:" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in (*CONTROLS, *own)) + ")")


def escape(text: str, pattern: re.Pattern) -> str:
    return pattern.sub(lambda m: m[0] + "\\", text)


_ESCAPED = re.compile(r"\\\\|\\", re.S)


def unescape(text: str) -> str:
    """Of two backslashes one stays; a single one goes."""
    return _ESCAPED.sub(lambda m: "\\" if len(m[0]) == 2 else "", text)


def render(turns: list[tuple[str, str]], pattern: re.Pattern) -> tuple[str, list[tuple[int, int]]]:
    """(whole text, character span of each turn's text). Null roles and texts are empty."""
    parts, spans, at = [START], [], len(START)
    for role, text in turns:
        head = OPEN + escape(role or "", pattern) + CLOSE
        body = escape(text or "", pattern)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted, len(START))]


def tokens_of(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The range of tokens that meet each character span; both sorted, found by binary search."""
    if not spans:
        return []
    a, b = np.array(spans).T
    low = np.searchsorted(ends, a, side="right")  # first token that ends behind the start
    high = np.searchsorted(starts, b, side="left")  # first token that starts at or behind the end
    return [(int(x), int(max(x, y))) if s < e else (int(x), int(x)) for x, y, s, e in zip(low, high, a, b)]


def encode(turns: list[tuple[str, str]], path: str, loss_role: str = "assistant") -> dict:
    """One conversation: formatted, ids, starts, ends, and loss: token ranges (first, end) of the turns of ``loss_role``."""
    tokenizer, pattern = encoder(path)
    formatted, spans = render(turns, pattern)
    found = tokenizer.encode(formatted, add_special_tokens=False)
    edges = np.fromiter(chain.from_iterable(found.offsets), np.int32).reshape(-1, 2)
    wanted = [s for s, (role, _) in zip(spans, turns) if role == loss_role]
    loss = [r for r in tokens_of(wanted, edges[:, 0], edges[:, 1]) if r[0] < r[1]]
    return {"formatted": formatted, "ids": np.array(found.ids, np.int32), "starts": edges[:, 0], "ends": edges[:, 1], "loss": loss, "n_turns": len(turns)}


FORMATTED = "formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<struct<first: int, end: int>>, n_turns long"


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    edges = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(arrays).astype(np.int32)))


def _ranges(lists: list[list[tuple[int, int]]]) -> pa.ListArray:
    edges = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    first, end = np.array([r for x in lists for r in x], np.int32).reshape(-1, 2).T
    return pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([pa.array(first), pa.array(end)], ["first", "end"]))


def format_chats(rows: DataFrame, path: str | None = None, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, ids, starts, ends, loss, n_turns) of every conversation in (conv_id, turn, role, text) rows.

    Turns go by number, null first, ties by role and text, repeated rows included. Null
    conv_id is one conversation; it may be of any type that can be compared. Conversations are dealt by id and
    sorted in Spark, which spills; a task holds about 4 MB of rendered conversations at a time, and a longer one whole, as
    it is one row of the result. Other columns are ignored, whatever their names.
    """
    path = path or default_path()
    kind = rows.schema["conv_id"].dataType.simpleString()
    narrow = rows.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "text"]

    def out(done, id_kind):
        ids, chats = zip(*done)
        columns = [pa.array(ids, id_kind), pa.array([c["formatted"] for c in chats], pa.string())]
        columns += [_lists([c[k] for c in chats]) for k in ("ids", "starts", "ends")]
        columns += [_ranges([c["loss"] for c in chats]), pa.array([c["n_turns"] for c in chats], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "formatted", "ids", "starts", "ends", "loss", "n_turns"])

    def run(batches):
        now, turns, done, size, id_kind = None, [], [], 0, None
        for batch in arrow_batches(batches, 1024, "text"):
            id_kind = batch.column("conv_id").type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if turns and conv != now:
                    done.append((now, encode(turns, path, loss_role)))
                    size += len(done[-1][1]["formatted"])
                    turns = []
                    if size > 4 << 20:
                        yield out(done, id_kind)
                        done, size = [], 0
                now = conv
                turns.append((role, text))
        if turns:
            done.append((now, encode(turns, path, loss_role)))
        if done:
            yield out(done, id_kind)

    return narrow.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, f"conv_id {kind}, {FORMATTED}")


def loss_text(formatted: str, starts, ends, loss: list[tuple[int, int]]) -> str:
    """All text under the loss mask, unescaped; characters of several tokens count once."""
    return unescape("".join(formatted[starts[a] : ends[b - 1]] for a, b in loss))


def digests(chats: DataFrame) -> DataFrame:
    """Digests of stored conversations, parsed back from the stored text and mask."""
    kind = chats.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"]

    def run(batches):
        for batch in arrow_batches(batches, 64, "formatted"):
            edges = {k: batch.column(k).offsets.to_numpy().tolist() for k in ("ids", "starts", "ends", "loss")}
            starts, ends = (batch.column(k).values.to_numpy() for k in ("starts", "ends"))
            first, last = (batch.column("loss").values.field(k).to_numpy() for k in ("first", "end"))
            rows = []
            for i, formatted in enumerate(batch.column("formatted").to_pylist()):
                turns = parse(formatted)
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                a, b = edges["loss"][i], edges["loss"][i + 1]
                loss = loss_text(formatted, starts[edges["starts"][i] :], ends[edges["ends"][i] :], list(zip(first[a:b].tolist(), last[a:b].tolist())))
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted), edges["ids"][i + 1] - edges["ids"][i], int((last[a:b] - first[a:b]).sum())))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    return chats.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long")


def op4_chat(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id int, turn int, role string, text string")
    more = more.select(*(F.col(f.name).cast(f.dataType) for f in rows.schema.fields))
    found = digests(materialize(format_chats(rows.unionByName(more)), "chats"))
    return found.drop("n_tokens", "n_loss_tokens")
