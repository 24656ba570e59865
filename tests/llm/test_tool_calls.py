import json

from cellspark.llm import tool_calls as t
from cellspark.llm.common import numbered

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, depends_on string, level int"
RESULTS = "conv_id long, turn long, call_id string, content string, copies string"
SCHEMAS = {"f": {"a": ("integer", True), "b": ("string", False), "o": ("object", False)}, "g": {}}


def brute(calls, results):
    """Rows by (conversation, identifier), and the rows that link with nothing."""
    first, answers = {}, {}
    for conv, turn, i, *rest in calls:
        if conv is not None and i is not None:
            first.setdefault((conv, i), []).append((turn, *rest))
    for conv, turn, i, content in results:
        if conv is not None and i is not None:
            answers.setdefault((conv, i), []).append((turn, content))
    low = lambda xs: min(xs, key=lambda x: tuple((v is not None, v) for v in x))
    up = {k: (k[0], low(v)[3]) for k, v in first.items()}

    def level(k):
        seen = []
        while up[k] in first:
            if k in seen:
                return None
            seen.append(k)
            k = up[k]
        return len(seen)

    out = {}
    for k, v in first.items():
        turn, name, arguments, depends = low(v)
        try:
            args = json.loads(arguments or "")
        except ValueError:
            args = None
        if not isinstance(args, dict):
            problems = ["arguments:unreadable"]
        elif name not in SCHEMAS:
            problems = ["name:unknown"]
        else:
            kinds = {"integer": lambda x: type(x) is int, "string": lambda x: type(x) is str, "object": lambda x: type(x) is dict}
            problems = [f"{a}:unknown" for a in args if a not in SCHEMAS[name]]
            for a, (kind, needed) in SCHEMAS[name].items():
                problems += [f"{a}:type"] if a in args and not kinds[kind](args[a]) else [f"{a}:missing"] if a not in args and needed else []
        if level(k) is None:
            problems = sorted(problems) + ["cycle"]
        else:
            problems.sort()
        got = low(answers[k])[1] if k in answers else None
        message = json.dumps({"arguments": args, "depends_on": depends, "id": k[1], "name": name, "result": got}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        out[k] = (turn, len(v), level(k), k in answers, ";".join(problems), message)
    order = sorted(out, key=lambda k: (k[0], 2**62 if out[k][2] is None else out[k][2], (out[k][0] is not None, out[k][0]), k[1]))
    place = {k: sum(j[0] == k[0] for j in order[: i + 1]) for i, k in enumerate(order)}
    lost = [("call:unidentified", c, i, turn) for c, turn, i, *_ in calls if c is None or i is None]
    lost += [("result:orphan", c, i, turn) for c, turn, i, _ in results if c is None or i is None]
    lost += [("result:orphan", *k, low(v)[0]) for k, v in answers.items() if k not in first]
    return {k: (*v, place[k]) for k, v in out.items()}, sorted(lost, key=str)


def fixture():
    long_text = json.dumps({"a": 7, "b": "é\n\"\\ " + "long " * 20_000}, ensure_ascii=False)
    calls = [
        (1, 0, "c0", "f", '{"b": "x", "a": 1}', None), (1, 2, "c2", "f", '{"a": "1", "z": null}', "c0"), (1, 4, "c4", "g", "{}", "c2"), (1, 4, "c3", "g", "{}", "c0"),
        (1, 6, "x", "f", long_text, "nowhere"), (1, 7, "x", "f", "{}", "c0"), (1, 7, "x", "f", "{}", "c0"),
        (2, 0, "p", "g", "{}", "q"), (2, 1, "q", "g", "{}", "p"), (2, 2, "r", "h", "[1]", "q"), (2, 3, "s", "f", '{"a": 2, "o": {"y": [1, {"k": 2, "b": true}], "a": 1.5}}', "s"), (2, None, "t", "f", "{broken", ""),
        (3, 0, "", None, None, None), (None, 1, "c0", "f", "{}", None), (1, 9, None, "f", "{}", None), (None, None, None, None, None, None),
    ]
    results = [(1, 1, "c0", "ok"), (1, 1, "c0", "later   text"), (1, 3, "c2", None), (2, 4, "p", ""), (9, 1, "c0", "no call"), (None, 1, "c0", "x"), (1, 2, None, "x"), (1, 8, "c9", "y"), (1, 7, "c9", "z")]
    return calls, results


def test_same_as_brute_force(spark):
    calls, results = fixture()
    df = t.link(spark.createDataFrame([(*c, 5) for c in calls], CALLS), spark.createDataFrame([(*r, "z") for r in results], RESULTS), SCHEMAS)
    got = df.collect()
    linked, lost = brute(calls, results)
    rows = {(r.conv_id, r.call_id): (r.turn, r.copies, r.level, r.linked, r.error, r.message, r.position) for r in got if r.message is not None}
    assert rows == linked
    assert all(r.valid == (r.error == "") for r in got)
    assert sorted([(r.error, r.conv_id, r.call_id, r.turn) for r in got if r.message is None], key=str) == lost


def test_levels_of_a_long_chain(spark):
    n = 130
    chain = spark.createDataFrame([(1, f"c{i}", f"c{i - 1}") for i in range(n)], "conv_id long, call_id string, depends_on string")
    assert {r.call_id: r.level for r in t.levels(chain).collect()} == {f"c{i}": i for i in range(n)}


def test_numbers_within_keys(spark):
    rows = [(k % 3 if k % 5 else None, (k * 7) % 31) for k in range(200)]
    got = numbered(spark.createDataFrame(rows, "k int, v int").repartition(5), ["k"], ["v"], "place").collect()
    for key in (None, 0, 1, 2):
        mine = sorted((r.place, r.v) for r in got if r.k == key)
        assert [p for p, _ in mine] == list(range(1, len(mine) + 1)) and [v for _, v in mine] == sorted(v for k, v in rows if k == key)


def test_empty_tables(spark):
    calls, results = spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS)
    assert t.link(calls, results, SCHEMAS).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", None), (None, None, "assistant", "x"), (1, 2, None, "y")], "conv_id long, turn long, role string, text string")
    got = t.link(*t.conversation_calls(turns), t.TOOLS).collect()
    assert {(r.call_id, r.error) for r in got if r.conv_id == 1} == {("c-1", "result:orphan"), ("c1", "key:type")} and [r.error for r in got if r.conv_id is None] == ["call:unidentified"]
