"""Largest overlap by rare elements first, against counting all pairs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from odspark.operators import enrich as en


def brute(a, b, null_keys):
    ok = lambda x: x[0] is not None and (null_keys == "match" or None not in x[1:])
    left, right = {x for x in a if ok(x)}, {x for x in b if ok(x)}
    n = Counter((x[0], y[0]) for x in left for y in right if x[1:] == y[1:])
    best = {}
    for (who, whom), k in n.items():
        best[who] = min(best.get(who, (0, "~")), (-k, whom))
    return {(who, whom, -k) for who, (k, whom) in best.items()}


@pytest.mark.parametrize("null_keys", ["drop", "match"])
@pytest.mark.parametrize("common", [64, 3, 1, 0])
def test_best_overlap(spark, null_keys, common):
    r = random.Random(common)

    def side(prefix, n):
        rows = [(f"{prefix}{i}", "hub", 1) for i in range(n)]  # a pair that all routes have
        for i in range(n):
            rows += [(f"{prefix}{i}", r.choice(["s1", "s2", "s3", None, f"own{r.randrange(30)}"]), r.choice([1, 2, None]))
                     for _ in range(r.randrange(0, 8))]
            if i % 3 == 0:  # many routes with the same common pairs
                rows += [(f"{prefix}{i}", f"line{k}", k) for k in range(4)]
        return rows + [(None, "hub", 1)] + rows[:5]
    a, b = side("n", 40), side("i", 30)
    want = brute(a, b, null_keys)
    schema = "name string, stop string, seq int"
    fa, fb = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema.replace("name", "id"))
    got = en.best_overlap(fa, fb, "name", "id", ["stop", "seq"], null_keys, common)
    assert {tuple(x) for x in got.collect()} == want
    assert en.best_overlap(fa.limit(0), fb, "name", "id", ["stop", "seq"], null_keys, common).count() == 0


def test_a_pair_of_all_routes_does_not_pair_the_routes(spark):
    """300 x 300 routes that share one pair: no join gives their product."""
    side = lambda p, n: spark.range(300).select(F.concat(F.lit(p), F.lpad(F.col("id").cast("string"), 3, "0")).alias(n),
                                                F.lit("hub").alias("stop"), F.lit(1).alias("seq"))
    got = en.best_overlap(side("n", "name"), side("i", "id"), "name", "id", ["stop", "seq"])
    assert {(x.id, x.matches) for x in got.collect()} == {("i000", 1)} and got.count() == 300
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "Cross" not in plan
