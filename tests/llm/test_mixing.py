import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenar.llm import mixing
from lumenar.llm.mixing import exact_total, mix_sources, reached_shares, water_fill

sources = st.lists(st.tuples(st.floats(0, 1), st.integers(0, 10**6), st.integers(0, 6)), min_size=1, max_size=8)


@settings(max_examples=300, deadline=None)
@given(sources, st.none() | st.floats(1, 10**7))
def test_water_filling(rows, total):
    given = [(f"s{i}", *r) for i, r in enumerate(rows)]
    everything = sum(a for _, t, a, r in given if t > 0 and a * r > 0)
    assert water_fill(given) == water_fill(given, everything)
    shares = water_fill(given, exact_total(given) if total is None else total)
    for s in shares:
        assert -1e-6 <= s.tokens <= s.available * s.max_repeats + 1e-3
        assert abs(s.whole * s.available + s.part - s.tokens) < 1e-2
    capacity = sum(s.available * s.max_repeats for s in shares if s.target > 0)
    if total is not None:
        assert sum(s.tokens for s in shares) == pytest.approx(min(total, capacity), rel=1e-6, abs=1e-3)
        free = [s for s in shares if 0 < s.tokens < s.available * s.max_repeats * (1 - 1e-9)]
        for a, b in zip(free, free[1:]):  # those not clamped keep their proportion
            assert a.tokens * b.target == pytest.approx(b.tokens * a.target, rel=1e-6)
    else:
        live = [s for s in shares if s.target > 0 and s.available * s.max_repeats > 0]
        for a, b in zip(live, live[1:]):  # every target is reached
            assert a.tokens * b.target == pytest.approx(b.tokens * a.target, rel=1e-6)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_mix(spark):
    docs = [(i, "big", 10 + i % 7) for i in range(3000)] + [(5000 + i, "small", 11) for i in range(40)] + [(9000 + i, None, 5) for i in range(9)] + [(9100, "none", 7), (9200, "big", 0)]
    goals = [("big", 0.7, 1), ("small", 0.3, 3), ("absent", 0.0, 2)]
    sized, wanted = table(spark, docs), targets(spark, goals)
    mix = mix_sources(sized, wanted, total="exact").collect()
    caps = {"big": 1, "small": 3}
    assert all(1 <= r.repeats <= caps[r.source] and r.n_tokens > 0 for r in mix) and len({r.doc_id for r in mix}) == len(mix)
    used = {s: sum(r.n_tokens * r.repeats for r in mix if r.source == s) for s in caps}
    assert used["small"] == 40 * 11 * 3 and abs(used["big"] - used["small"] * 7 / 3) <= 9
    report = {r.source: r for r in reached_shares(mix_sources(sized, wanted, total="exact"), sized, wanted).collect()}
    assert abs(report["big"].share - 0.7) < 0.005 and report["absent"].used_tokens == 0 and report["small"].epochs == 3.0
    assert sorted(map(tuple, mix_sources(sized, wanted, total="exact").collect())) == sorted(map(tuple, mix))
    other = mix_sources(sized, wanted, total="exact", seed=5).collect()
    assert {r.doc_id for r in other if r.source == "big"} != {r.doc_id for r in mix if r.source == "big"}


def test_given_total_clamps(spark):
    sized, wanted = table(spark, [(i, "a" if i < 10 else "b", 10) for i in range(200)]), targets(spark, [("a", 0.5, 2), ("b", 0.5, 1)])
    mix = mix_sources(sized, wanted, total=1000).collect()
    used = {s: sum(r.n_tokens * r.repeats for r in mix if r.source == s) for s in "ab"}
    assert used == {"a": 200, "b": 800}


def test_all_tokens_are_the_total_and_small_sources_are_clamped(spark):
    """Without a total: 2000 tokens; a may give 200, b is clamped at 300, what both leave goes to c in proportion."""
    docs = [(i, "a", 10) for i in range(10)] + [(100 + i, "b", 10) for i in range(30)] + [(1000 + i, "c", 10) for i in range(160)]
    sized, wanted = table(spark, docs), targets(spark, [("a", 0.4, 2), ("b", 0.3, 1), ("c", 0.3, 4)])
    report = {r.source: r for r in reached_shares(mix_sources(sized, wanted), sized, wanted).collect()}
    assert {s: r.used_tokens for s, r in report.items()} == {"a": 200, "b": 300, "c": 1500}
    assert {s: r.clamped for s, r in report.items()} == {"a": True, "b": True, "c": False} and report["c"].share == 0.75


@pytest.mark.parametrize("buckets", [1, 2, 3, 4096])
def test_the_part_is_cut_in_any_number_of_buckets(spark, monkeypatch, buckets):
    monkeypatch.setattr(mixing, "BUCKETS", buckets)
    sized, wanted = table(spark, [(i, "ab"[i % 2], 1 + i % 5) for i in range(400)]), targets(spark, [("a", 0.6, 3), ("b", 0.4, 3)])
    used = {r.source: r.used_tokens for r in reached_shares(mix_sources(sized, wanted), sized, wanted).collect()}
    assert abs(used["a"] - 0.6 * 1200) <= 3 and abs(used["b"] - 0.4 * 1200) <= 3


def test_empty(spark):
    wanted = targets(spark, [("a", 1.0, 1)])
    assert mix_sources(table(spark, []), wanted).count() == 0
    assert mix_sources(table(spark, [(1, "a", 5)]), wanted.limit(0)).count() == 0
    assert [tuple(r) for r in mix_sources(table(spark, [(1, "a", 5), (1, "a", 5)]), wanted).collect()] == [(1, "a", 5, 1)] * 2


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    names = ("bucket", "whole", "part", "cut", "before", "more", "repeats", "available_tokens", "used_docs")
    sized = table(spark, [(i, "a", 3) for i in range(50)]).withColumns({n: F.lit("x") for n in names})
    wanted = targets(spark, [("a", 1.0, 1)]).withColumns({n: F.lit("x") for n in names})
    mix = mix_sources(sized, wanted, total=75)
    assert sum(r.n_tokens for r in mix.collect()) == 75
    assert reached_shares(mix, sized, wanted).first().share == 1.0
