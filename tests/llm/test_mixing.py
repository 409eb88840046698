import itertools
import random

import pytest

from claimloom.llm import mixing


def test_targets_follow_the_weights_up_to_the_cap():
    got = mixing.weighted_targets({"a": 10, "b": 100, None: 890}, {"a": 1, "b": 2, None: 3})
    assert got["a"] == 30 and got["b"] == 300 and got[None] == pytest.approx(670)
    assert mixing.weighted_targets({}, {}) == {}
    assert mixing.weighted_targets({"a": 0, "b": 5}, {"a": 1, "b": 2}) == {"a": 0.0, "b": 5.0}


def cost(given, patterns):
    total = 0
    for p, by in given.items():
        got = sum(by.values())
        total += sum(k * max(0, min(patterns[p], got - k * patterns[p])) for k in range(3))
    return total


def test_route_fills_most_at_least_cost():
    rnd = random.Random(3)
    for _ in range(30):
        names = ["x", "y", "z"]
        patterns = {p: rnd.randint(0, 3) for k in (1, 2) for p in itertools.combinations(names, k) if rnd.random() < 0.5}
        quotas = {s: rnd.randint(0, 5) for s in names}
        given = mixing.route(patterns, quotas)
        for s in names:
            assert sum(by.get(s, 0) for by in given.values()) <= quotas[s]
        assert all(sum(by.values()) <= 3 * patterns[p] for p, by in given.items())
        edges = [(p, s) for p in patterns for s in p]
        best = (0, 0)
        for amounts in itertools.product(*[range(min(3 * patterns[p], quotas[s]) + 1) for p, s in edges]) if len(edges) <= 5 else []:
            trial = {p: {} for p in patterns}
            for (p, s), a in zip(edges, amounts):
                trial[p][s] = a
            if any(sum(by.values()) > 3 * patterns[p] for p, by in trial.items()) or any(sum(by.get(s, 0) for by in trial.values()) > quotas[s] for s in names):
                continue
            best = max(best, (sum(amounts), -cost(trial, patterns)))
        if len(edges) <= 5:
            assert (sum(sum(by.values()) for by in given.values()), -cost(given, patterns)) == best


def test_mix_reaches_quotas_with_overlapping_sources(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([["a"], ["b"], ["a", "b"], ["b", "a", "a"], [None], [], None]), rnd.choice([0, 1, 7, 40, None])) for i in range(400)]
    rows += [(None, ["a"], 9), (5, ["a"], 9), (5, ["a"], 9)]
    docs = spark.createDataFrame(rows, "id long, sources array<string>, size long")
    quotas = {"a": 2500.0, "b": 300.0, None: 700.0}
    got = mixing.mix(docs, quotas).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert sum(r.taken for r in got if r.pattern in ("[null]", '[]', None)) == 700
    assert sum(r.taken for r in got) == 3500
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7), quotas).collect()))
    assert mixing.mix(docs.limit(0), quotas).collect() == []


def test_sources_with_control_characters_are_taken(spark):
    names = ["a\x0bb", "\x1b[0m", "\x1f", "\x0e\x0f", 'q"\\/', "\x7f\u2028é"]
    docs = spark.createDataFrame([(i, [s], 10) for i, s in enumerate(names)], "id long, sources array<string>, size long")
    got = mixing.mix(docs, {s: 10.0 for s in names}).collect()
    assert sorted((r.id, r.taken) for r in got) == [(i, 10) for i in range(len(names))]
