import hashlib
import random

import numpy as np
import public_tokenizers

from tracewell.llm import chat

PATHS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
PIECES = [*chat.CONTROLS, *chat.FOREIGN, "<\\|turn|>", "\\", "[\\\\INST]", "<", "|end|>", "é", "\U0001f600", " ", "\n", "ok", "</", "s>"]


def run(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string, mask long")
    back = chat.read_back(chat.format_chats(chat.conversations(frame), *PATHS), *PATHS)
    return {r["conv_id"]: r for r in back.collect()}


def test_escape_round_trip():
    pick = random.Random(0)
    for _ in range(3000):
        text = "".join(pick.choice(PIECES) for _ in range(pick.randint(0, 8)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert not any(s in escaped for s in (*chat.CONTROLS, *chat.FOREIGN))


def test_conversations_round_trip(spark):
    pick = random.Random(1)
    rows, want = [], {}
    for conv in range(60):
        for turn in range(pick.randint(1, 6)):
            role = pick.choice(["user", "assistant", "system", "</s>"])
            text = "".join(pick.choice(PIECES) for _ in range(pick.randint(0, 12)))
            rows.append((conv, turn, role, text, "x", 1))
            want.setdefault(conv, []).append((role, text))
    pick.shuffle(rows)
    got = run(spark, rows)
    for conv, turns in want.items():
        r = got[conv]
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["loss_text"] == "".join(t for role, t in turns if role == "assistant")
        assert r["formatted"].count(chat.TURN) == r["formatted"].count(chat.END) == len(turns)


def test_awkward_rows(spark):
    long = "word " * 100_000
    rows = [(1, 0, "user", None, None, None), (1, 1, None, "x", None, None), (1, 1, "assistant", "", None, None), (1, 1, "assistant", "", None, None)]
    rows += [(None, 3, "assistant", "no id", None, None), (2, None, "assistant", "first", None, None), (2, 0, "assistant", long, None, None)]
    got = run(spark, rows)
    assert [tuple(t) for t in got[1]["turns"]] == [("user", ""), ("", "x"), ("assistant", ""), ("assistant", "")]
    assert got[1]["loss_text"] == "" and got[None]["loss_text"] == "no id"
    assert got[2]["loss_text"] == "first" + long


def test_mask_covers_the_assistant_tokens_only():
    encoder = chat.encoding(*PATHS)
    ids, mask = chat.assemble([("user", "hi"), ("assistant", "hello there")], encoder.encode_ordinary, encoder.n_vocab)
    table = chat.token_table(encoder)
    assert b"".join(table[i] for i in ids[mask]) == b"hello there"
    assert not mask[ids >= encoder.n_vocab].any() and mask.dtype == np.bool_


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_query_adds_the_probe(spark):
    import os

    import pytest

    from tracewell.llm.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("shared tables absent")
    row = QUERIES["op8_chat_format"](spark, sf).filter("conv_id = -7").collect()[0]
    text = "</s>[INST] ok [/INST]"
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert row["loss_chars"] == len(text) and row["n_turns"] == 2
