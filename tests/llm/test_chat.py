import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from strandmill.llm.chat import CONTROLS, digests, encode, encoder, escape, format_chats, loss_text, op4_chat, parse, render, tokens_of, unescape
from strandmill.llm.tokens import default_path

SCHEMA = "conv_id long, turn long, role string, text string, ids string, n_turns int"
PIECES = ["</s>", "[INST]", "[/INST]", "<s>", "\\", "\\\\", "<|endoftext|>", "<", "/s>", "[\\INST]", " ok ", "\n", "é", "日", "", "  ", "s>", "😀"]


def odd(rng):
    return "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))


def test_escaping_is_reversible_and_complete():
    pattern, rng = encoder(default_path())[1], random.Random(1)
    for text in [*PIECES, *(odd(rng) for _ in range(3000))]:
        hidden = escape(text, pattern)
        assert unescape(hidden) == text
        assert not any(c in hidden for c in (*CONTROLS, "<|endoftext|>"))


def test_render_and_mask():
    rng = random.Random(2)
    plain = Tokenizer.from_file(default_path())
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "system", odd(rng), None]), rng.choice([odd(rng), None, "Some words here.\n"])) for _ in range(rng.randint(0, 6))]
        c = encode(turns, default_path())
        assert parse(c["formatted"]) == [(r or "", t or "") for r, t in turns]
        assert loss_text(c["formatted"], c["starts"], c["ends"], c["loss"]) == "".join(t or "" for r, t in turns if r == "assistant")
        assert not set(c["ids"].tolist()) & {50256} and c["ids"][0] == plain.get_vocab_size()
        assert encoder(default_path())[0].decode(c["ids"].tolist(), skip_special_tokens=False) == c["formatted"]


def test_binary_search_meets_a_plain_scan():
    rng = random.Random(3)
    for _ in range(200):
        edges = sorted(rng.sample(range(60), 9))
        starts, ends = np.array(edges[:-1]), np.array(edges[1:])
        points = sorted(rng.choices(edges, k=6))
        spans = list(zip(points[::2], points[1::2]))
        for (a, b), (x, y) in zip(spans, tokens_of(spans, starts, ends)):
            assert list(range(x, y)) == [i for i in range(8) if starts[i] < b and ends[i] > a]


def wanted(rows):
    chats = defaultdict(list)
    for conv, turn, role, text in rows:
        chats[conv].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    out = {}
    for conv, turns in chats.items():
        turns = [(t[3], t[5]) for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(render(turns, encoder(default_path())[1])[0]))
    return out


def test_tables(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant"]), odd(rng)) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(7, 2, "user", "tie"), (7, 2, "user", "tie"), (7, None, "system", "first"), (None, 1, "assistant", "no id"), (None, 0, None, None), (500, 0, "assistant", None), (501, 0, "assistant", "long " * 50_000)]
    rows += [(600, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(3000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in digests(format_chats(docs)).collect()}
    assert got == wanted(rows)
    assert digests(format_chats(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("kind", ["int", "string", "decimal(10,0)"])
def test_other_types_of_id(spark, tmp_path, kind):
    rows = [(c, t, "assistant" if t else "user", f"said {c} {t}") for c in range(9) for t in range(3)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(f"cast(conv_id as {kind}) as conv_id", "cast(turn as int) as turn", "role", "text")
    docs.write.parquet(f"{tmp_path}/conversations.parquet")
    got = op4_chat(spark, str(tmp_path))
    assert got.schema["conv_id"].dataType == docs.schema["conv_id"].dataType
    said = "</s>[INST] ok [/INST]"
    assert {int(r.conv_id): (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in got.collect()} == wanted([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])


def test_query_on_the_small_tables(spark):
    import duckdb

    rows = duckdb.sql("select conv_id, turn, role, text from '/root/testdata/sf0.01/conversations.parquet'").fetchall()
    said = "</s>[INST] ok [/INST]"
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in op4_chat(spark, "/root/testdata/sf0.01").collect()}
    assert got == wanted([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert got[-7][2] == len(said)
