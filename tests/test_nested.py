import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenar.operators import nested
from lumenar.operators.nested import explode_nodes, index_nested, nodes_of


def strict(_):
    raise ValueError


class Number(str):
    """A number's own text."""


def brute(text):
    """(path, parent, non-null fields, scalar fields) of every object, by a plain walk."""
    out = []

    def walk(value, path, parent, top):
        if isinstance(value, Number):
            return
        if isinstance(value, str):
            if not (value.lstrip(" \t\n\r")[:1] == "{" or top and value):
                return
            try:
                inner = json.loads(value, parse_constant=strict, parse_float=Number, parse_int=Number)
            except ValueError:
                return
            walk(inner, path, parent, top) if isinstance(inner, dict) or top else None
        elif isinstance(value, dict):
            out.append((path, parent, sum(v is not None for v in value.values()), {k: v if isinstance(v, str) else None if v is None else json.dumps(v) for k, v in value.items() if not isinstance(v, (dict, list))}))
            for k, v in value.items():
                walk(v, f"{path}.{k}" if path else k, path, False)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                walk(v, f"{path}[{i}]", parent, False)

    try:
        top = json.loads(text, parse_constant=strict, parse_float=Number, parse_int=Number) if text else None
    except (ValueError, RecursionError):
        return []
    if not isinstance(top, (int, float, bool)):
        walk(top, "", None, True)
    return out


def ours(texts):
    per = [[] for _ in texts]
    for rec, path, parent, n, fields in nodes_of(texts):
        per[rec].append((path, parent, n, fields))
    return per


def same(texts):
    for text, found in zip(texts, ours(texts)):
        key = lambda x: (x[0], str(x[1]), x[2], json.dumps(x[3], sort_keys=True))
        assert sorted(map(key, found)) == sorted(map(key, brute(text))), text


HAND = [
    None, "", " ", "3", "null", '""', '"x"', "[]", "{}", '{"a":1}', '[1,{"a":{"b":null}},[{"c":1}]]', '{"a":1,}', '{"a","b":1}', '{"a":"{\\"x\\":{\\"y\\":1}}"}',
    '{"a":[{"q":1}, null, {"z":"\\u007b\\"k\\":2}"}]}', "nul", '{"a":1} {"b":2}', '{"a":tru}', "[1 2]", '{"a" "b"}', "}{", '{"a":{"b":[{}]}}', '"{\\"a\\":{\\"b\\":1}}"',
    '{"a":"x\\"y{","b":{"c":"\\\\"}}', '{"é":{"ñ":1}}', ' {"a" : { } } ', "[", '"', '{"a":"\x01"}', '{"a":"\\x"}', '{"a":"\\u12"}', '{"a":{"b":1}}]', '[[],[[{"d":[]}]]]', '{"a":01}', '{"a":1.}', '{"a":-}',
    '{"a":NaN}', "{" * 50, '{"a":' * 300 + "1" + "}" * 300, '{"a":"\\\\\\"{}[]:,"}', '{"":{"":1}}', '{"a":[[[[{"b":1}]]]]}', "[,]", '{"a":[1,]}', '{"a"::1}', '{:1}', '{"a":1:2}', '["a":1]', "{1:2}", '{"a":{"b":"{\\"c\\":"}}',
]


def test_hand_cases():
    same(HAND)


values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=25)


@settings(max_examples=150, deadline=None)
@given(st.lists(values, min_size=1, max_size=6), st.booleans(), st.booleans())
def test_random_documents(docs, ascii_only, pack):
    texts = [json.dumps({"s": json.dumps(d)} if pack else d, ensure_ascii=ascii_only) for d in docs]
    same(texts)


@settings(max_examples=150, deadline=None)
@given(values, st.integers(0, 10**6))
def test_broken_documents(doc, seed):
    text, rnd = json.dumps(doc), random.Random(seed)
    cut = rnd.randrange(len(text) + 1)
    same([text[:cut], text, text[:cut] + rnd.choice('{}[]:,"\\ 1n') + text[cut:], text])


def test_one_bad_text_does_not_spoil_its_neighbours(monkeypatch):
    monkeypatch.setattr(nested, "CHUNK_BYTES", 30)
    same(['{"a":{"b":1}}', '{"a":"', '{"c":{"d":2}}', '"', '{"e":[{"f":3}]}'] * 3)


def test_operator(spark):
    rows = [(1, '{"a":{"b":1},"l":[{"x":null},{"y":2}]}', "k"), (2, None, "k"), (1, '{"a":{"b":1},"l":[{"x":null},{"y":2}]}', "k")]
    df = spark.createDataFrame(rows, "id int, json string, node_path string")
    out = index_nested(df, "json").collect()
    assert sorted((r.id, len(r.nodes)) for r in out) == [(1, 4), (1, 4), (2, 0)] and out[0].node_path == "k"
    flat = explode_nodes(index_nested(df.drop("node_path").filter("id = 1").limit(1), "json"))
    assert {(r.node_path, r.parent_path, r.n_fields, r.collection, r.ordinal) for r in flat.collect()} == {("", None, 2, "", None), ("a", "", 1, "a", None), ("l[0]", "", 0, "l", 0), ("l[1]", "", 1, "l", 1)}
    assert index_nested(df.limit(0), "json").count() == 0
    with pytest.raises(ValueError):
        index_nested(df, "json", out="id")
