import json
import random

from pyspark.sql import functions as F

from courtside.llm import chats

HARD = ["", "\\", "\\s", "\\l", "<", "</turn>\n", "<turn>user\n", "\\### Assistant: </turn> ok", "a\nb\n", "\\\\sl<\\", "é\U0001F600<", "\n", " "]


def test_escapes_are_reversible(spark):
    r = random.Random(1)
    texts = HARD + ["".join(r.choice("\\sln<>/turn\n ") for _ in range(r.randrange(0, 25))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for role in (False, True):
        got = df.select("t", chats.escape(F.col("t"), role).alias("e")).select("t", "e", chats.unescape(F.col("e"), role).alias("u")).collect()
        assert all(x["t"] == x["u"] and "<" not in x["e"] and not (role and "\n" in x["e"]) for x in got)


def test_round_trip_of_rows(spark):
    r = random.Random(2)
    rows = []
    for conv in range(12):
        for turn in range(r.randrange(1, 9)):
            rows.append((conv, turn, r.choice(["user", "assistant", "system", "a\nb<", None]), r.choice([*HARD, None])))
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "first"), (50, 1, "user", "b"), (50, 1, "user", "a"), (50, 1, "user", "a"), (51, 0, "assistant", None)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "conv_id bigint, turn bigint, role string, text string, head int, start int")
    got = {x["conv_id"]: x for x in chats.read_back(chats.format_rows(df)).collect()}
    assert set(got) == {x[0] for x in rows}
    for conv, x in got.items():
        mine = sorted((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv)
        assert [tuple(t) for t in x["turns"]] == [m[2:] for m in mine]
        assert x["learned"] == [m[3] for m in mine if m[2] == "assistant"]
    assert chats.read_back(chats.format_rows(df.limit(0))).count() == 0


def test_layouts_of_json_records(spark):
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "gpt", "content": "a"}]}, "messages", [("user", "q"), ("assistant", "a")]),
        ({"id": 7, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, "conversations", [("user", "q"), ("assistant", None)]),
        ({"instruction": "do", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
        ({"instruction": "do", "input": "", "output": "done"}, "instruction_input", [("user", "do"), ("assistant", "done")]),
        ({"prompt": "p", "completion": "c", "meta": {"role": 1}}, "completion", [("user", "p"), ("assistant", "c")]),
        ({"prompt": "p", "response": 5}, "response", [("user", "p"), ("assistant", "5")]),
        ({"turns": [{"role": "user", "text": "t", "turn": 0}]}, "turns", [("user", "t")]),
        ({"other": 1}, None, None), ({"prompt": "p"}, None, None), ({"prompt": "p", "messages": []}, None, None),
    ]
    rows = [(i, json.dumps(x[0])) for i, x in enumerate(records)] + [(100, None), (101, "no json"), (102, "[]")]
    got = {r["id"]: r for r in chats.turns_of_json(spark.createDataFrame(rows, "id bigint, j string"), "id", "j").collect()}
    for i, (_, layout, turns) in enumerate(records):
        assert got[i]["layout"] == layout and (got[i]["turns"] and [tuple(t) for t in got[i]["turns"]]) == turns
    assert all(got[i]["layout"] is None and got[i]["turns"] is None for i in (100, 101, 102))


def test_layouts_of_tables(spark):
    a = spark.createDataFrame([(1, "q", "a", 3)], "id bigint, prompt string, response string, score int")
    b = spark.createDataFrame([(2, [("human", "q")]), (3, None)], "id bigint, conversations array<struct<from:string,value:string>>")
    c = spark.createDataFrame([(4, "x")], "id bigint, text string")
    rows = [chats.turns_of_table(d, "id") for d in (a, b, c)]
    got = {r["id"]: (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in rows[0].union(rows[1]).union(rows[2]).collect()}
    assert got == {1: ("response", [("user", "q"), ("assistant", "a")]), 2: ("conversations", [("user", "q")]), 3: ("conversations", []), 4: (None, None)}
    d = spark.createDataFrame([(5, 3, "user", "t", "x")], "id bigint, turn int, role string, text string, lang string")
    assert [tuple(r) for r in chats.turn_rows(d, "id").collect()] == [(5, 3, "user", "t")]
    assert [tuple(r) for r in chats.turn_rows(b, "id").collect()] == [(2, 0, "user", "q")] and chats.turn_rows(c, "id").count() == 0
    paths = spark.range(1).select(chats.fingerprint(F.array(F.lit("b"), F.lit("a"), F.lit("b")))).first()[0]
    assert paths == chats.digest(["a", "b"])
    out = chats.read_back(chats.format_rows(chats.rows_of_turns(rows[0], "id"), "id"), "id").first()
    assert out["learned"] == ["a"]


def test_no_record_vanishes(spark):
    records = {
        1: {"messages": [{"role": "user"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        2: {"messages": []},
        3: {"system": "s", "instruction": "i", "input": "n", "output": "o"},
        4: {"odd": 1},
        5: {"instruction": "", "output": ""},
        6: {"conversations": [{"value": "x"}, {"from": "human"}]},
    }
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in records.items()] + [(7, None)], "id bigint, j string")
    rows, rest = chats.rows_and_rest(chats.turns_of_json(df, "id", "j"), "id")
    got = {}
    for r in sorted(rows.collect()):
        got.setdefault(r["id"], []).append((r["role"], r["text"]))
    assert got == {
        1: [("user", None), ("user", "q"), ("assistant", "a")], 3: [("system", "s"), ("user", "i"), ("user", "n"), ("assistant", "o")],
        6: [(None, "x"), ("user", None)],
    }
    assert {r["id"]: (r["layout"], r["reason"]) for r in rest.collect()} == {
        2: ("messages", "no turns"), 4: (None, "unknown layout"), 5: ("instruction", "no turns"), 7: (None, "unknown layout"),
    }


def test_very_long_texts(spark):
    long = "<\\x" * 700_000
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long + "!")], "conv_id bigint, turn bigint, role string, text string")
    got = chats.read_back(chats.format_rows(df)).first()
    assert got["learned"] == [long + "!"] and got["turns"][0]["text"] == long
