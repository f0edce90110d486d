"""The mixture against the true target weights, and with more sources than lanes."""

from collections import Counter

import pytest

from juristrata.llm import mixing


def rows_of(spark, sizes):
    return spark.createDataFrame([(k, s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))], "doc_id long, source string").repartition(3)


def furthest(got, weights):
    """The largest distance, in blocks, of any source from its true share after any number of slots before one ran out."""
    total, seen, far = sum(weights.values()), Counter(), 0.0
    for t, (slot, source) in enumerate(sorted({(r["slot"], r["source"]) for r in got if r["within"]}), 1):
        assert slot == t - 1
        seen[source] += 1
        far = max(far, *(abs(seen[s] - t * w / total) for s, w in weights.items()))
    return far, sum(seen.values())


def test_shares_are_the_largest_remainders_of_the_true_weights(spark):
    for sources, hot in [(20, 139.6), (200, 47.7)]:
        # One source holds a third of the rows; weights are square roots.
        sizes = {"hot": (sources - 1) * 10 // 2} | {f"s{k}": 10 for k in range(sources - 1)}
        total = sum(n**0.5 for n in sizes.values())
        p = {r["key"][1:]: r["p"] for r in mixing.targets(rows_of(spark, sizes), power=0.5).collect()}
        assert sum(p.values()) == 1000 and all(abs(p[s] - 1000 * n**0.5 / total) < 1 for s, n in sizes.items())
        assert abs(p["hot"] - hot) < 1.1


def test_small_weights_get_a_slot_and_the_rest_stays_in_proportion(spark):
    sizes = {"hot": 1, "warm": 1} | {f"s{k}": 1 for k in range(8)}
    weights = {"hot": 2e6, "warm": 1e6} | {f"s{k}": 1 for k in range(8)}
    p = {r["key"][1:]: r["p"] for r in mixing.targets(rows_of(spark, sizes), weights, slots=100).collect()}
    assert sum(p.values()) == 100 and all(p[f"s{k}"] == 1 for k in range(8)) and abs(p["hot"] - 61.7) < 1 and abs(p["warm"] - 30.3) < 1


def test_mixture_follows_the_true_weights_over_a_long_stream(spark):
    sizes = {"hot": 1900} | {f"s{k}": 190 for k in range(20)}
    weights = {s: n**0.5 for s, n in sizes.items()}
    far, slots = furthest(mixing.mix(rows_of(spark, sizes), power=0.5, block_rows=1).collect(), weights)
    assert slots > 4000 and far < 2


@pytest.mark.parametrize("sources, lanes", [(1200, 256), (60, 8)])
def test_any_number_of_sources(spark, sources, lanes):
    sizes = {"hot": 900} | {f"s{k}": 1 + k % 9 for k in range(sources)}
    weights = {s: n**0.5 for s, n in sizes.items()}
    got = mixing.mix(rows_of(spark, sizes), power=0.5, block_rows=1, lanes=lanes).collect()
    assert len(got) == sum(sizes.values()) == len({r["doc_id"] for r in got}) == len({r["slot"] for r in got})
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    far, slots = furthest(got, weights)
    assert slots > 0 and far < 2
    # Also beyond the first end of a source no source is starved: the hot one has its share of the first slots.
    first = [r["source"] for r in sorted(got, key=lambda r: r["slot"])[: len(got) // 4]]
    share = len(first) * weights["hot"] / sum(weights.values())
    assert abs(first.count("hot") - share) < 2 + share / 20
