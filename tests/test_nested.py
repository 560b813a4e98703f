import json
import re

from rootline.operators import nested

SCHEMA = "node_id string, key string, value string"


def found(spark, *values):
    rows = [(f"n{i}", "k", v) for i, v in enumerate(values)]
    return {(r.node_id, r.path, r.parent_path) for r in nested.elements(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_paths_of_elements(spark):
    value = '{"a":{"b":[{"c":[1,2,{"d":[[{"e":1}],[]]}]}, {}]},"per-col":[{"x y":[{}]}]}'
    assert found(spark, value) == {
        ("n0", "$.a.b[0]", "$"),
        ("n0", "$.a.b[0].c[2]", "$.a.b[0]"),
        ("n0", "$.a.b[0].c[2].d[0][0]", "$.a.b[0].c[2]"),
        ("n0", "$.a.b[1]", "$"),
        ("n0", "$.per-col[0]", "$"),
        ("n0", "$.per-col[0].x y[0]", "$.per-col[0]"),
    }


def test_what_counts_as_json(spark):
    assert found(spark, '[{"a":NaN}]', json.dumps('[{"a":1}]'), '  [ {} ] ') == {(f"n{i}", "$[0]", "$") for i in range(3)}
    assert found(spark, "[{'a':1}]", '[{"a":1}', '[{"a":1}] x', '[{"a":Infinity}]', "5", "null", None, "", '"text"', json.dumps('[{"a":1}'), json.dumps(json.dumps("[{}]"))) == set()


def test_duplicates_spellings_and_extras(spark):
    rows = [("A ", " K", "[{}]", "p"), ("a", "k", "[ {} ]", "q")]
    df = spark.createDataFrame(rows, SCHEMA + ", path string")
    assert [tuple(r) for r in nested.elements(df).collect()] == [("a", "k", "$[0]", "$")]
    assert nested.elements(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deep_and_long(spark):
    depth = 300
    deep = '[{"c":' * depth + "1" + "}]" * depth
    wide = json.dumps([{"v": "x" * 50}] * 5000)
    assert len(found(spark, deep)) == depth
    assert len(found(spark, wide)) == 5000
    assert found(spark, "[" * 200_000 + "]" * 200_000) == set()


def test_any_depth_and_any_number(spark):
    digits, deep = "7" * 5000, 30_000
    values = [f'[{{"n":{digits}}}]', "[" * deep + ' { "x" : [ {} ] } , 1' + "]" * deep, '{"a":' * deep + "[{}]" + "}" * deep, json.dumps("[" * deep + "{}" + "]" * deep)]
    bad = ["[" * deep + "{}," + "]" * deep, "[" * deep + "{}" + "]" * (deep - 1), '{"a":' * deep + "[{}]" + "}" * deep + " x", "[" * deep + "Infinity, {}" + "]" * deep]
    inner = "$" + "[0]" * deep
    assert found(spark, *values, *bad) == {("n0", "$[0]", "$"), ("n1", inner, "$"), ("n1", f"{inner}.x[0]", inner), ("n2", "$" + ".a" * deep + "[0]", "$"), ("n3", inner, "$")}
    row = next(r for r in nested.shred(spark.createDataFrame([("n", "k", f'[{{"n":{digits},"m":[{digits},1,"a"]}}]')], SCHEMA)).collect() if r.path == "$[0]")
    assert row.members == {"n": digits, "m": "[]"}


def test_deep_decoder_equals_the_plain_one():
    texts = ['{"a": [1, {"b": null}, "x\\u00e9", -1.5e3, true], "a": []}', " [ ] ", "{}", '{"a":1,}', "[1,]", "[1 2]", '{"a" 1}', "{1:2}", "[1]]", "", "[", "[NaN]", "[-Infinity]", '["a\nb"]', "5", '"s"']
    for text in texts:
        try:
            plain = repr(nested._decoder.decode(text))
        except ValueError:
            plain = None
        try:
            deep = repr(nested._decode_deep(text))
        except ValueError:
            deep = None
        assert deep == plain, text


def test_tables_and_schema(spark):
    rows = [("n", "k", '{"run":"r","items":[{"id":1,"pos":{"x":1.5},"tags":["a"],"sub":[{"t":true}]},{"id":2.5,"pos":{"x":null}},{"id":"z"}]}')]
    shredded = nested.shred(spark.createDataFrame(rows, SCHEMA))
    merged = {(r.level, r["name"]): r.col_type for r in nested.schema(shredded).collect()}
    assert merged[("$.items[]", "id")] == "json"
    assert merged[("$.items[]", "pos.x")] == "double"
    assert merged[("$.items[].sub[]", "t")] == "boolean"
    made = nested.tables(shredded)
    assert set(made) == {"$", "$.items[]", "$.items[].sub[]", "$.items[].tags[]"}
    assert [tuple(r) for r in made["$.items[].tags[]"].select("path", "parent_path", "ordinal", "element").collect()] == [("$.items[0].tags[0]", "$.items[0]", 0, "a")]
    sub = made["$.items[].sub[]"].first()
    assert (sub.parent_path, sub.ordinal, sub["m.t"]) == ("$.items[0]", 0, True)
    items = made["$.items[]"].orderBy("ordinal").collect()
    assert [(r.ordinal, r.parent_path, r["m.pos.x"], r["m.tags"]) for r in items] == [(0, "$", 1.5, "[]"), (1, "$", None, None), (2, "$", None, None)]
    assert made["$"].first()["m.run"] == "r"


def rebuilt(rows):
    """The value that the rows of one source row stand for."""
    made = {}
    for r in rows:
        if r.kind == "value":
            made[r.level, r.path] = json.loads(r.members[""])
        elif r.kind == "array":
            made[r.level, r.path] = []
        else:
            out = {}
            for name, text in r.members.items():
                at, parts = out, [re.sub(r"\\(.)", r"\1", x) for x in re.findall(r"(?:\\.|[^.\\])+|(?<=\.)(?=\.|$)|^(?=\.|$)", name)]
                for x in parts[:-1]:
                    at = at.setdefault(x, {})
                at[parts[-1]] = json.loads(text)
            made[r.level, r.path] = out
    steps = lambda level: re.findall(r"\[\]|\.(?:\\.|[^.\[\\])*", level)
    for r in sorted((r for r in rows if r.ordinal is not None), key=lambda r: (len(steps(r.level)), r.ordinal)):
        holder, found = r.level[:-2], r.path[: r.path.rindex("[")]
        if (holder, found) in made:  # an element of an inner or outermost array
            at = made[holder, found]
        else:
            owner_level = max((lv for lv, p in made if p == r.parent_path and r.level.startswith(lv) and isinstance(made[lv, p], dict)), key=len)
            at = made[owner_level, r.parent_path]
            for s in steps(holder[len(owner_level) :]):
                at = at[re.sub(r"\\(.)", r"\1", s[1:])]
        at.append(made[r.level, r.path])
    return made["$", "$"]


VALUES = [
    {"a": [{"x": 1, "b": [{"y": "s"}, {"y": None}]}, {"x": 2, "b": []}]},
    {"m": [[1, 2], [3, 4]]},
    [1, 2, 3],
    {"a": [1, {"x": 2}, "s", None, True, [], {}]},
    {"a": {"b": 1}, "a.b": 2},
    {"a": {"b": [{"x": 1}]}, "a.b": [{"x": 2}], "c[]": [5], "c": [[6]]},
    {"e": {}, "f": [], "g": {"h": {}, "i": [[[], [{}]]]}},
    [[[{"k": [[{"z": [1.5, [2]]}]]}], 7], {"k": {"l": [None]}}],
    {"b\\s": {"q.r": "x"}},
]


def test_round_trip(spark):
    """Every value can be built again from the rows of its tables."""
    rows = nested.shred(spark.createDataFrame([(f"n{i}", "k", json.dumps(v)) for i, v in enumerate(VALUES)], SCHEMA)).collect()
    for i, v in enumerate(VALUES):
        assert rebuilt([r for r in rows if r.node_id == f"n{i}"]) == v, v


def test_a_schema_too_large_to_share_guides_nothing(spark, monkeypatch):
    """The same rows with and without the guidance of a schema, over many tasks."""
    df = spark.createDataFrame([(f"n{i}", "k", json.dumps(v)) for i, v in enumerate(VALUES * 5)], SCHEMA).repartition(7)
    assert nested.infer(df) is not None
    guided = [{tuple(r) for r in f(df).collect()} for f in (nested.elements, lambda d: nested.shred(d).select("node_id", "path", "parent_path", "level", "kind"))]
    monkeypatch.setattr(nested, "MAX_PLACES", 3)
    assert nested.infer(df) is None
    assert [{tuple(r) for r in f(df).collect()} for f in (nested.elements, lambda d: nested.shred(d).select("node_id", "path", "parent_path", "level", "kind"))] == guided
    assert len(guided[0]) == 5 * len({(i, p) for i, v in enumerate(VALUES) for _, p, q, *_ in nested.walk(v, None, False) if q})
