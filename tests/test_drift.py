import json

from lumenar.operators.drift import edit_script, file_schemas, project_record, schema_changes, steady_table


def feed(spark, files, extra=()):
    rows = [("f", n, f"{n}.json", i, r if isinstance(r, str) or r is None else json.dumps(r), n) for n, records in files.items() for i, r in enumerate(records)] + list(extra)
    return spark.createDataFrame(rows, "feed string, file_no int, file_name string, rec_no int, payload string, at int").selectExpr("feed", "file_no", "file_name", "rec_no", "payload", "timestamp_seconds(at) as arrived_at")


def changes(spark, files, extra=()):
    return sorted(tuple(r) for r in schema_changes(feed(spark, files, extra)).collect())


def test_every_kind(spark):
    files = {
        1: [{"id": 1, "a": "x", "views": 3, "o": {"p": 1, "q": 2}, "gone": True}, {"id": 2, "a": None}],
        2: [{"id": 1, "b": "x", "views": "3", "o": {"p": 1, "q": 2}, "new": 1.5}],
        3: [{"id": 1, "b": "x", "views": "3", "r": {"p": 1, "q": 2}, "new": 1.5}, '{"id": 9, "cut', None, "[1]"],
        4: [{"id": 1, "b": {"href": "x"}, "views": "3", "r": {"p": 1}, "new": 1.5}],
    }
    assert changes(spark, files) == [
        ("f", 2, "a", "renamed", "b"), ("f", 2, "gone", "removed", ""), ("f", 2, "new", "added", ""), ("f", 2, "views", "retyped", ""),
        ("f", 3, "o", "renamed", "r"), ("f", 4, "b", "retyped", ""), ("f", 4, "r.q", "removed", ""),
    ]


def test_no_evidence_is_no_rename(spark):
    assert changes(spark, {1: [{"id": 1, "a": "x"}], 2: [{"id": 2, "b": "x"}]}) == [("f", 2, "a", "removed", ""), ("f", 2, "b", "added", "")]
    assert changes(spark, {1: [{"id": 1, "a": "x"}], 2: [{"id": 1, "b": "y"}]}) == [("f", 2, "a", "removed", ""), ("f", 2, "b", "added", "")]
    assert changes(spark, {1: [{"a": "x"}], 2: [{"b": "x"}]}) == [("f", 2, "a", "removed", ""), ("f", 2, "b", "added", "")]


def test_added_object_counts_once_and_moves_are_renames(spark):
    assert changes(spark, {1: [{"id": 1}], 2: [{"id": 1, "o": {"p": {"q": 1}}}]}) == [("f", 2, "o", "added", "")]
    assert changes(spark, {1: [{"id": 1, "o": {"c": "x", "d": 1}}], 2: [{"id": 1, "o": {"d": 1}, "c": "x"}]}) == [("f", 2, "o.c", "renamed", "c")]


def test_gaps_repeats_and_dirt(spark):
    assert changes(spark, {1: [{"id": 1, "a": 1}], 3: [{"id": 1, "b": 1}]}) == []
    twice = [("f", 1, "1.json", 0, '{"id": 1, "a": 1}', 9), ("f", 2, "2.json", 0, '{"id": 1, "b": 1}', 9), (None, 1, "x", 0, "{}", 1), ("f", None, "x", 0, "{}", 1)]
    assert changes(spark, {1: [{"id": 1, "a": 1}], 2: [{"id": 1, "b": 1}]}, twice) == [("f", 2, "a", "renamed", "b")]
    assert schema_changes(feed(spark, {1: [{}]}).limit(0)).count() == 0
    assert file_schemas(feed(spark, {1: ["broken"]})).collect()[0].fields == []


def test_script_is_cheapest():
    evidence = {("a", "x"): (1, 1), ("a", "y"): (3, 3), ("b", "y"): (1, 1)}
    cost, script = edit_script({"a": "string", "b": "string"}, {"x": "string", "y": "string"}, evidence)
    assert script == [("a", "renamed", "x"), ("b", "renamed", "y")] and cost < 1.3
    assert edit_script({}, {}, {}) == (0.0, [])
    assert edit_script({"a": "string"}, {"a": "string"}, {}) == (0.0, [])


def test_steady_table(spark):
    files = {1: [{"id": 1, "a": "x", "o": {"p": 1}}], 2: [{"id": 1, "b": "x", "o": {"p": 2}}], 3: [{"id": 1, "c": "z", "q": {"p": 2}}, {"id": 1, "b": "x"}, "bad"]}
    files[3][0] = {"id": 1, "c": "x", "q": {"p": 2}}
    files[3][1] = {"id": 5, "c": "w"}
    records = feed(spark, files, [("f", 1, "1.json", 0, '{"id": 1, "a": "later"}', 99)])
    found = {(r.file_no, r.rec_no): r["values"] for r in steady_table(records, schema_changes(records)).collect()}
    assert found == {(1, 0): {"id": "1", "a": "later"}, (2, 0): {"id": "1", "a": "x", "o.p": "2"}, (3, 0): {"id": "1", "a": "x", "o.p": "2"}, (3, 1): {"id": "5", "a": "w"}, (3, 2): None}


def test_projection_of_odd_records():
    assert project_record(None, {}) is None
    assert project_record("{}", {}) == {}
    assert project_record('{"a": [1, {"b": null}]}', {}) == {"a": "[1, {}]"}
    assert project_record('{"x": {"b": 1}, "y": null}', {"x": "o"}) == {"o.b": "1"}


def test_a_name_that_is_taken_loses_no_value(spark):
    files = {1: [{"id": 1, "a": "x"}], 2: [{"id": 1, "b": "x"}], 3: [{"id": 1, "a": "new", "b": "x"}]}
    records = feed(spark, files)
    found = {r.file_no: r["values"] for r in steady_table(records, schema_changes(records)).collect()}
    assert found == {1: {"id": "1", "a": "x"}, 2: {"id": "1", "a": "x"}, 3: {"id": "1", "a@3": "new", "a": "x"}}
    assert project_record('{"a": 1, "b": 2}', {"b": "a"}) == {"a": "1", "a@b": "2"}
