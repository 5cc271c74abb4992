"""As-of lookups against a loop over all history."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from turnbook.operators.asof import asof_join


def random_tables(rng):
    history = [
        (rng.choice("ab"), rng.choice([None, *range(40)]), rng.choice([None, 1, 2, 3, -1]), rng.randint(0, 3))
        for _ in range(120)
    ]
    # One key holds most rows, one has no history, one has no name.
    requests = [(rng.choice(["a", "a", "b", "c", None]), rng.choice([None, *range(45)]), i // 2) for i in range(150)]
    return history + [(None, 5, 9, 9)], requests


@pytest.mark.parametrize("strictly", [False, True])
@pytest.mark.parametrize("width", [1, 7, 100])
def test_asof_equals_a_loop(spark, strictly, width):
    history, requests = random_tables(random.Random(width))
    found = asof_join(
        spark.createDataFrame(requests, "k string, t int, id int").withColumn("price", F.lit("replaced")),
        spark.createDataFrame(history, "k string, t int, price int, size int").withColumn("id", F.lit("other")),
        ("k",),
        "t",
        ("price", "size"),
        span=F.floor(F.col("t") / width),
        usable=F.col("price") > 0,
        strictly=strictly,
    )
    assert found.columns == ["k", "t", "id", "price", "size"]

    def expected(k, t):
        known = [
            (ht, price, size)
            for hk, ht, price, size in history
            if hk == k and None not in (t, ht, price) and price > 0 and (ht < t if strictly else ht <= t)
        ]
        return max(known)[1:] if known else (None, None)

    wanted = [(k, t, i, *expected(k, t)) for k, t, i in requests]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)


def test_asof_of_empty_tables(spark):
    one = spark.createDataFrame([("a", 1)], "k string, t int")
    none = spark.createDataFrame([], "k string, t int, v int")
    span = F.col("t")
    assert [tuple(x) for x in asof_join(one, none, ("k",), "t", ("v",), span).collect()] == [("a", 1, None)]
    assert asof_join(none.drop("v"), none, ("k",), "t", ("v",), span).collect() == []
