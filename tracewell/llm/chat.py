"""Chat formatting by token-level assembly.

A conversation becomes token ids: each turn is a reserved id, the role, a reserved id, the
text and a reserved id. Role and text are encoded separately, so no token spans a boundary,
and reserved ids lie above the vocabulary, so no text can produce them. Control strings that
occur in a text (those of the template, and of other common templates) are escaped by a
backslash after their first character; existing ones get one more, which makes it
reversible. The loss mask is the running sum of +1 at the first token of an assistant's text
and -1 after its last one.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import slices

# The template's control strings, in the order of their reserved ids.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
CONTROLS = (TURN, BODY, END)
# Control strings of other templates that texts may hold.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>")
TEXT_SLICE = 2_000_000

_ESCAPE = re.compile("|".join(rf"(?<={re.escape(s[0])})\\*(?={re.escape(s[1:])})" for s in (*CONTROLS, *FOREIGN)))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m.group()[1:], text)


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """The byte-level vocabulary at ``path``; an ``Encoding`` without special tokens."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def assemble(turns: list[tuple[str, str]], encode, reserved: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, loss mask) of the turns (role, text); the mask covers the assistant's texts."""
    parts: list = []
    steps: list[tuple[int, int]] = []
    at = 0
    for role, text in turns:
        head, body = encode(escape(role)), encode(escape(text))
        parts += [[reserved], head, [reserved + 1], body, [reserved + 2]]
        first = at + 2 + len(head)
        if role == "assistant":
            steps += [(first, 1), (first + len(body), -1)]
        at = first + len(body) + 1
    ids = np.fromiter((i for p in parts for i in p), np.uint32, at)
    delta = np.zeros(at + 1, np.int8)
    for where, step in steps:
        delta[where] += step
    return ids, np.cumsum(delta[:-1]).astype(bool)


def _text(ids: np.ndarray, table: list[bytes]) -> str:
    return b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8")


def disassemble(ids: np.ndarray, table: list[bytes], reserved: int) -> list[tuple[str, str]]:
    """The turns (role, text) read back from the ids."""
    starts, bodies, ends = (np.flatnonzero(ids == reserved + k) for k in range(3))
    return [(unescape(_text(ids[a + 1 : b], table)), unescape(_text(ids[b + 1 : c], table))) for a, b, c in zip(starts, bodies, ends)]


def loss_text(ids: np.ndarray, mask: np.ndarray, table: list[bytes]) -> str:
    """The text under the mask, unescaped run by run."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return "".join(unescape(_text(ids[a:b], table)) for a, b in zip(edges[::2], edges[1::2]))


def token_table(encoder) -> list[bytes]:
    """The bytes of every id, the reserved ones included."""
    return [encoder.decode_single_token_bytes(i) for i in range(encoder.n_vocab)] + [c.encode() for c in CONTROLS]


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) with the turns of each conversation in order as (turn, role, text).

    Null roles and texts are empty; turns that tie are ordered by role, then text, and
    repeated rows stay turns of their own; null turns come first; rows whose conv_id is null
    are one conversation. A conversation is one row of the result by its nature.
    """
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_chats(chats: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(conv_id, ids, mask): little-endian unsigned 32-bit ids and one byte a token (1: loss)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(vocabulary, pattern)
        for batch in batches:
            texts = pc.list_flatten(batch.column(1))
            owner = pc.list_parent_indices(batch.column(1)).to_numpy()
            long = np.bincount(owner, pc.binary_length(texts.field(2)).to_numpy(zero_copy_only=False), len(batch)) if len(texts) else np.zeros(len(batch))
            for a, b in slices(long.astype(int).tolist(), TEXT_SLICE):
                made = [assemble([(t["role"], t["text"]) for t in turns], encoder.encode_ordinary, encoder.n_vocab) for turns in batch.column(1).slice(a, b - a).to_pylist()]
                ids = pa.array([i.astype("<u4").tobytes() for i, _ in made], pa.binary())
                mask = pa.array([m.astype(np.uint8).tobytes() for _, m in made], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids, mask], ["conv_id", "ids", "mask"])

    return chats.select("conv_id", "turns").mapInArrow(work, "conv_id long, ids binary, mask binary")


def read_back(formatted: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(conv_id, turns array<(role, text)>, loss_text, formatted) decoded from ids and mask."""
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(vocabulary, pattern)
        table, reserved = token_table(encoder), encoder.n_vocab
        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column(1)).to_pylist(), 4 * TEXT_SLICE):
                part = batch.slice(a, b - a)
                ids = [np.frombuffer(x, "<u4") for x in part.column(1).to_pylist()]
                masks = [np.frombuffer(x, np.uint8) for x in part.column(2).to_pylist()]
                turns = [[{"role": r, "text": t} for r, t in disassemble(i, table, reserved)] for i in ids]
                loss = [loss_text(i, m, table) for i, m in zip(ids, masks)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(turns, turn), pa.array(loss, pa.string()), pa.array([_text(i, table) for i in ids], pa.string())], ["conv_id", "turns", "loss_text", "formatted"])

    return formatted.select("conv_id", "ids", "mask").mapInArrow(work, "conv_id long, turns array<struct<role:string,text:string>>, loss_text string, formatted string")
