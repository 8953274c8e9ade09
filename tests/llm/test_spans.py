import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenar.llm import spans
from lumenar.llm.spans import covered, hash_records, record_pairs, repeated_runs, runs, shared_report, shared_spans, span_pairs, starts, without_repeats

LEAST = 40


def brute(rows, least):
    held = {}
    for rid, *texts in rows:
        for t in texts:
            for i in range(len(t or "") - least + 1):
                held.setdefault(t[i : i + least], set()).add(rid)
    return {(a, b) for ids in held.values() for a in ids for b in ids if a < b}


def brute_cover(rows, least):
    held = {}
    for rid, *texts in rows:
        for t in texts:
            for i in range(len(t or "") - least + 1):
                held.setdefault(t[i : i + least], set()).add(rid)
    out = {}
    for rid, *texts in rows:
        total = 0
        for t in texts:
            mark = [False] * len(t or "")
            for i in range(len(t or "") - least + 1):
                if len(held[t[i : i + least]]) > 1:
                    mark[i : i + least] = [True] * least
            total += sum(mark)
        out[rid] = total
    return out


def make(seed, n=14):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 8)))
    pool = ["".join(rnd.choice([word() + " ", word() + ". ", word() + "? ", word() + ",\n", "x" * rnd.randint(1, 60)]) for _ in range(rnd.randint(1, 16))) for _ in range(6)]
    rows = []
    for rid in range(n):
        texts = []
        for _ in range(2):
            parts = []
            for _ in range(rnd.randint(0, 4)):
                piece = rnd.choice(pool)
                a = rnd.randrange(len(piece))
                parts.append(rnd.choice(["", word() + " ", word() + ". "]) + piece[a : a + rnd.randint(LEAST - 3, LEAST + 60)])
            texts.append(rnd.choice([None, "", "".join(parts)]) if rnd.random() < 0.2 else "".join(parts))
        rows.append((rid, *texts))
    return rows


def run(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, a string, b string")
    return shared_spans(df, "id", ["a", "b"], LEAST)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("hot", [64, 2])
def test_pairs_and_cover_like_brute_force(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(spans, "HOT", hot)
    rows = make(seed)
    found = run(spark, rows).cache()
    assert {tuple(r) for r in span_pairs(found).collect()} == brute(rows, LEAST)
    df = spark.createDataFrame(rows, "id bigint, a string, b string")
    assert {tuple(r) for r in record_pairs(df, "id", ["a", "b"], LEAST).collect()} == brute(rows, LEAST)
    report = {r.id: r for r in shared_report(df, found, "id", ["a", "b"]).collect()}
    assert {i: r.shared_chars for i, r in report.items()} == brute_cover(rows, LEAST)
    assert all(r.n_chars == sum(len(t or "") for t in rows[i][1:]) for i, r in report.items())
    found.unpersist()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\n\"", max_size=300), st.integers(30, 60))
def test_no_gap_without_starts(text, least):
    at = [*starts(text, least), len(text)]
    assert at == sorted(at) and all(b - a <= least - 12 for a, b in zip(at, at[1:]))


def test_exact_length(spark):
    text = "".join(chr(97 + i * 7 % 26) for i in range(LEAST))
    for size, want in ((LEAST, {(1, 2)}), (LEAST - 1, set())):
        rows = [(1, "Q. " + text[:size] + "1", None), (2, None, "w_" + text[:size] + "2"), (3, "", None)]
        assert {tuple(r) for r in span_pairs(run(spark, rows)).collect()} == want


def test_repeats_are_kept_once(spark):
    same = "The coast guard found the old map. Nobody knows why it was lost again."
    rows = [(1, same + " One.", None), (2, "Two. " + same, None), (3, None, same + " Three."), (4, None, None)]
    df = spark.createDataFrame(rows, "id bigint, a string, b string")
    found = shared_spans(df, "id", ["a", "b"], LEAST)
    assert {(r.id, r.a, r.b) for r in without_repeats(df, found, "id", ["a", "b"]).collect()} == {(1, same + " One.", None), (2, "Two. ", None), (3, None, "Three."), (4, None, None)}
    assert covered(found).count() == 3
    assert span_pairs(shared_spans(df.limit(0), "id", ["a", "b"], LEAST)).count() == 0 == record_pairs(df.limit(0), "id", ["a", "b"], LEAST).count()


def test_runs_of_sentences():
    text = "Short one. " * 4 + "A longer sentence that goes on and on for a good while. End."
    at = [0, 11, 22, 33, 44, 100]
    assert runs(text, 20) == [(a, a + 21) for a in at[:3]] + [(33, 99), (44, 104)]
    assert runs("One sentence that is long enough all by itself", 20) == [] and runs("", 20) == []


def test_equal_runs_are_found_by_their_hash_alone(spark):
    same = "The coast guard found it. Nobody knows why. The museum kept the map."
    rows = [(i, f"{i} x. {same}" if i % 2 else None, f"{same} y" if i % 2 == 0 else None) for i in range(7)] + [(50, "zz" + same[10:50] + "qq", None)]
    found = repeated_runs(hash_records(spark.createDataFrame(rows, "id bigint, a string, b string"), "id", ["a", "b"], LEAST))
    assert {tuple(r) for r in span_pairs(found).collect()} == {(a, b) for a in range(7) for b in range(a + 1, 7)}
    assert {r.rid: max(s["to"] - s["from"] for s in r.spans) for r in covered(found).collect()} == {i: len(same) if i % 2 else len(same) for i in range(7)}
