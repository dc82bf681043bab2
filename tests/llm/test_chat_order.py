"""Ties, null turns and whole conversations of the chat format, against the registered SQL."""

import random

import duckdb
import pytest

from matforge.llm import chat, queries


def test_ties_as_in_sql(spark, tmp_path):
    r = random.Random(4)
    texts = ["", None, "a", "b", "[INST]", "[/INST] x", "</s>", "[\\INST]", "~", "é"]
    rows = [(r.randrange(4), r.choice([None, 0, 1, 1, 2]), r.choice(["user", "system", "assistant", "tool", "[AS]", None]), r.choice(texts)) for _ in range(300)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op1_chat_format(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.OP1_SQL).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    whole = {x["conv_id"]: x["text"] for x in chat.conversations(chat.format_turns(spark.read.parquet(f"{tmp_path}/conversations.parquet"))).collect()}
    key = lambda x: (x[1] is None, x[1] or 0, (x[2] or "").encode(), (x[3] or "").encode())
    for c, text in whole.items():
        assert [t[:2] for t in chat.parse(text)] == [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == c), key=key)]


def test_reader_takes_any_cuts():
    turns = [("user", "</s>[INST] ok [/INST]"), ("assistant", "[\\INST] ü"), ("[AS]", ""), ("system", "x" * 50)]
    text = "".join(chat.render_turn(*t) for t in turns)
    for size in (1, 2, 3, 7, 1000):
        reader, got = chat.Reader(), []
        for i in range(0, len(text), size):
            got += reader.feed(text[i : i + size])
        reader.finish()
        assert [g[:2] for g in got] == turns and all(chat.unescape(text[b:e]) == t for _, t, b, e in got)
    with pytest.raises(chat.GrammarError):
        reader = chat.Reader()
        list(reader.feed("[INST]a"))
        reader.finish()
