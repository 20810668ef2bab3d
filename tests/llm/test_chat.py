import json
import random
import sys
from pathlib import Path

import duckdb

from tessera.llm import chat
from tessera.llm.chat import format_chats
from tessera.llm.queries import ORACLES, QUERIES

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from check import compare  # noqa: E402

TOOLS = {
    "find": {"q": ("string", True, 2), "top": ("integer", False, 1)},
    "sum": {"xs": ("array", True, None), "scale": ("number", False, None), "dry": ("boolean", False, None), "by": ("object", False, None)},
}


def call(*calls):
    return json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments", "after"), c)) for c in calls]})


def result(call_id, content):
    return json.dumps({"tool_call_id": call_id, "content": content})


def chats(spark, rows, tools=TOOLS):
    frame = spark.createDataFrame([(*r, "clash", 0) for r in rows], "conv_id long, turn int, role string, text string, kind string, depth int")
    return sorted(format_chats(frame, tools).collect(), key=lambda r: (str(r["conv_id"]), r["at"] or 0, r["depth"], r["turn"] or 0, r["seq"]))


def test_whole_table(spark, sf):
    oracle = duckdb.connect()
    oracle.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    problem, n = compare(QUERIES["op9_chat_format"](spark, sf), oracle, ORACLES["op9_chat_format"])
    assert not problem and n > 0


def test_links_and_order(spark):
    rows = [
        (1, 0, "system", "be brief"),
        (1, 1, "assistant", call(("a", "find", '{"q": "xx", "top": 3}', None), ("b", "find", {"top": 1, "q": "yy"}, ["a"]))),
        (1, 2, "tool", result("b", "B")),
        (1, 3, "tool", result("a", "A")),
        (1, 4, "tool", result("a", "again")),
        (1, 5, "tool", result("zz", None)),
        (1, 6, "assistant", call(("a", "find", "{}", None))),
        (2, 1, "tool", result("a", "early")),
        (2, 2, "assistant", call(("a", "find", '{"q":"zz"}', None))),
    ]
    got = chats(spark, rows)
    # b waits for the result of a (turn 3), its own result for b.
    assert [(r["conv_id"], r["at"], r["depth"], r["turn"], r["call_id"], r["status"]) for r in got] == [
        (1, 0, 0, 0, None, "message"),
        (1, 1, 0, 1, "a", "answered"),
        (1, 3, 0, 3, "a", "linked"),
        (1, 3, 1, 1, "b", "answered"),
        (1, 3, 2, 2, "b", "linked"),
        (1, 4, 0, 4, "a", "duplicate"),
        (1, 5, 0, 5, "zz", "orphan"),
        (1, 6, 0, 6, "a", "duplicate"),
        (2, 2, 0, 2, "a", "answered"),
        (2, 2, 1, 1, "a", "linked"),
    ]
    line = next(r["line"] for r in got if r["call_id"] == "b" and r["kind"] == "call")
    assert line == '{"arguments":{"q":"yy","top":1},"call_id":"b","conv_id":1,"kind":"call","name":"find","role":"assistant","status":"answered","turn":1}'


def test_cycles(spark):
    rows = [
        (1, 1, "assistant", call(("a", "find", '{"q":"aa"}', ["b"]), ("b", "find", '{"q":"bb"}', ["a"]), ("c", "find", '{"q":"cc"}', None))),
        (1, 2, "tool", result("a", "A")),
        (1, 3, "tool", result("b", "B")),
        (2, 1, "assistant", call(("s", "find", '{"q":"ss"}', ["s"]))),
        (3, 9, "assistant", call(("x", "find", '{"q":"xx"}', None))),
        (3, 1, "tool", result("x", "X")),
    ]
    got = {(r["conv_id"], r["call_id"], r["kind"]): r["status"] for r in chats(spark, rows)}
    assert got[1, "a", "call"] == got[1, "b", "call"] == got[2, "s", "call"] == "cyclic"
    assert got[1, "c", "call"] == "open"
    assert got[3, "x", "call"] == "answered" and got[3, "x", "result"] == "linked"


def brute_places(needs, turn):
    """(at, depth, cyclic) of every event, by recursion; ``needs`` maps an event to those before it."""
    endless, known = set(), {}
    for start in needs:  # reachable from itself, over needs
        todo, seen = list(needs[start]), set()
        while todo:
            e = todo.pop()
            if e not in seen:
                seen.add(e)
                todo += needs[e]
        if start in seen:
            endless.add(start)
    grown = True
    while grown:
        grown = {e for e in needs if e not in endless and endless & set(needs[e])}
        endless |= grown

    def place(e):
        if e not in known:
            known[e] = max([(turn[e], 0)] + [(at, depth + 1) for at, depth in map(place, needs[e])])
        return known[e]

    return {e: (turn[e], 0, True) if e in endless else (*place(e), False) for e in needs}


def test_order_of_any_graph(spark):
    rng = random.Random(6)
    rows, expected = [], {}
    for conv in range(12):
        n = rng.choice([3, 8, 25])
        turns = rng.sample(range(200), 2 * n)
        names = [f"c{i}" for i in range(n)]
        after = {x: rng.sample(names, rng.choice([0, 0, 0, 1, 1, 2])) for x in names}
        for i, x in enumerate(names):
            rows.append((conv, turns[i], "assistant", call((x, "find", '{"q":"xx"}', after[x] or None))))
            rows.append((conv, turns[n + i], "tool", result(x, x)))
        needs = {("call", x): [("result", y) for y in after[x]] for x in names} | {("result", x): [("call", x)] for x in names}
        turn = {("call", x): turns[i] for i, x in enumerate(names)} | {("result", x): turns[n + i] for i, x in enumerate(names)}
        expected |= {(conv, *e): p for e, p in brute_places(needs, turn).items()}
    got = {(r["conv_id"], r["kind"], r["call_id"]): (r["at"], r["depth"], r["status"] == "cyclic") for r in chats(spark, rows)}
    assert got == expected and 10 < sum(c for _, _, c in got.values()) < len(got) - 10


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """1,000 calls of which each waits for the one a turn later, beside a cycle that more calls wait for."""
    n, written, rounds = 1000, chat.written, []
    monkeypatch.setattr(chat, "written", lambda df, label: rounds.append(label) or written(df, label))
    rows = [(1, i, "assistant", call((str(i), "find", '{"q":"xx"}', [str(i + 1)]))) for i in range(n)]
    rows += [(1, n, "assistant", call((str(n), "find", '{"q":"xx"}', None), ("x", "find", '{"q":"xx"}', ["y"]), ("y", "find", '{"q":"xx"}', ["x"])))]
    rows += [(1, n + 1 + i, "assistant", call((f"z{i}", "find", '{"q":"xx"}', [f"z{i + 1}" if i < 20 else "x"]))) for i in range(21)]
    got = {r["call_id"]: r for r in chats(spark, rows)}
    assert len(rounds) < 45
    assert all((got[str(i)]["at"], got[str(i)]["depth"], got[str(i)]["status"]) == (n, n - i, "open") for i in range(n + 1))
    assert all(got[x]["status"] == "cyclic" and got[x]["depth"] == 0 and got[x]["at"] == got[x]["turn"] for x in ("x", "y", *(f"z{i}" for i in range(21))))


def test_schemas(spark):
    cases = {
        '{"q":"x"}': ["small q"],
        '{"q":7}': ["type q"],
        "{}": ["missing q"],
        '{"q":null}': ["missing q"],
        '{"q":"ok","top":1.5}': ["type top"],
        '{"q":"ok","top":0,"z":1}': ["extra z", "small top"],
        '["q"]': ["no object"],
        "nonsense {": ["no object"],
        '{"q":"ok"}': None,
    }
    rows = [(1, i, "assistant", call((str(i), "find", text, None))) for i, text in enumerate(cases)]
    rows += [(1, 50, "assistant", call(("50", "none", "{}", None), ("51", "sum", '{"xs":[1],"scale":2,"dry":true,"by":{"b":1,"a":[]}}', None), ("52", "sum", '{"xs":1,"scale":"2","dry":0,"by":[]}', None)))]
    got = {r["call_id"]: (r["n_errors"], json.loads(r["line"])) for r in chats(spark, rows)}
    for i, (text, errors) in enumerate(cases.items()):
        assert got[str(i)] == (len(errors or ()), got[str(i)][1]) and got[str(i)][1].get("errors") == errors, text
    assert got["50"][1]["errors"] == ["unknown tool"] and got["51"][0] == 0
    assert got["52"][1]["errors"] == ["type by", "type dry", "type scale", "type xs"]


def test_odd_rows(spark):
    texts = [None, "", "{", "{}", '{"tool_calls": []}', '{"tool_calls": "x"}', "ä\n\"q\"\\ \u0001 [x]", "y" * 100_000]
    rows = [(i % 3 if i % 4 else None, i, role, t) for i, t in enumerate(texts) for role in ("user", "assistant", "system", None)]
    rows += [(7, None, "user", "x"), rows[4], rows[4]]
    got = chats(spark, rows, {"reply": {"prompt": ("string", True, 1), "turn": ("integer", True, 0)}})
    assert len(got) == len(rows)
    for row in got:
        line = json.loads(row["line"])
        assert json.dumps(line, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == row["line"]
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert format_chats(empty).collect() == []


def test_plan_is_native(spark, sf):
    plan = QUERIES["op9_chat_format"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
