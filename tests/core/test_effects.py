import json

from pyspark.sql import functions as F

from lodeline.functions.text import string_list, tolerant_object
from lodeline.operators import planner
from lodeline.operators.planner import effects


def fold(outputs, declared):
    """The state of each run at each path, call by call."""
    state = {}
    for run, _, tool, output in sorted(outputs, key=lambda o: o[1]):
        for t, path, target, merge in declared:
            try:
                value = json.loads(output)
            except ValueError:
                continue
            for part in [x for x in path.split(".") if x] if t == tool else ():
                value = value.get(part) if isinstance(value, dict) else None
            if t != tool or value is None:
                continue
            here = state.get((run, target))
            if merge == "extend":
                state[run, target] = (here if isinstance(here, list) else []) + (value if isinstance(value, list) else [value])
            elif merge == "update" and isinstance(here, dict) and isinstance(value, dict):
                state[run, target] = here | value
            else:
                state[run, target] = value
    return state


def test_effects_fold_in_call_order_with_their_types(spark):
    declared = [("a", "x", "s.k", "set"), ("b", "x", "s.k", "extend"), ("c", "x", "s.k", "update"), ("d", "", "whole", "update")]
    values = ['{"x": 1}', '{"x": "one"}', '{"x": [1, "2", {"y": null}]}', '{"x": {"n": 1, "q\\"": [2]}}', '{"x": {"n": "1", "m": 2.5}}', '{"x": null}', '{"y": 1}', "no json", '{"x": []}', '{"x": {}}', '{"x": true}']
    outputs = [(r, i, "abcd"[(i * 7 + r) % 4], values[(i * (r + 3) + i // 5) % len(values)]) for r in range(9) for i in range(r * 3 + 1)]
    got = effects(spark.createDataFrame(outputs, "run int, call int, tool string, output string"), spark.createDataFrame(declared, "tool string, output_path string, state_path string, merge string"))
    assert {(r.run, r.state_path): json.loads(r.value) for r in got.collect()} == fold(outputs, declared)


def test_tolerant_objects_and_lists(spark):
    texts = ['x {"a": {"b": 1}, "c": 2} y', '```json\n{"n": {"m": [1, {"z": "}"}]}}\n``` {"q": 1}', '{"s": "a } { \\" }", "t": ["u", "v"]} tail }', "no", '{"open": {"a": 1}', "{bad}", None, "", '{"e": "' + '\\"' * 5000 + '", "t": "w"}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", tolerant_object(F.col("text")).alias("o"))
    got = [(r.o, r.t) for r in rows.select("i", "o", string_list(F.try_parse_json("o"), "$.t").alias("t")).orderBy("i").collect()]
    assert [json.loads(o) if o else None for o, _ in got] == [{"a": {"b": 1}, "c": 2}, {"n": {"m": [1, {"z": "}"}]}}, {"s": 'a } { " }', "t": ["u", "v"]}, None, None, None, None, None, {"e": '"' * 5000, "t": "w"}]
    assert got[2][1] == ["u", "v"] and got[8][1] == ["w"] and got[0][1] is None


def test_values_are_parsed_once_and_read_from_a_table(spark, monkeypatch):
    stored, kept = [], planner.materialise
    monkeypatch.setattr(planner, "materialise", lambda df, name: stored.append(name) or kept(df, name))
    outputs = [(1, 1, "a", '{"x": []}'), (1, 2, "a", '{"x": []}'), (2, 1, "b", '{"x": {}}'), (3, 1, "a", '{"x": [1]}'), (3, 2, "b", '{"x": {"k": 1}}'), (3, 3, "b", '{"x": {}}'), (4, None, "a", '{"x": [1]}')]
    got = effects(spark.createDataFrame(outputs, "run int, call int, tool string, output string"), spark.createDataFrame([("a", "x", "s", "extend"), ("b", "x", "s", "update")], "tool string, output_path string, state_path string, merge string"))
    assert stored == ["effects"] and "parse_json" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.run, r.value) for r in got.collect()} == {(1, "[]"), (2, "{}"), (3, '{"k":1}')}
