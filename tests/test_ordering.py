"""Distributed ordering against brute force."""

import random
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.operators import ordering


@pytest.mark.parametrize("rows", [0, 1, 500])
def test_running_before(spark, rows):
    generator = random.Random(rows)
    data = [(i, generator.choice("ab"), generator.randint(0, 9)) for i in range(rows)]
    df = spark.createDataFrame(data, "id long, name string, n long").repartition(6)
    order = [F.col("n").desc(), F.col("id").asc()]
    found = ordering.running_before(df, order, {"before": "n"}, ["name"]).collect()
    expected, sums = {}, Counter()
    for i, name, n in sorted(data, key=lambda r: (-r[2], r[0])):
        expected[i] = sums[name]
        sums[name] += n
    assert {r.id: r.before for r in found} == expected


def test_rank_with_ties_and_missing_values(spark):
    generator = random.Random(7)
    data = [(f"k{i}", generator.choice([None, 1, 2, 3, 3, 3])) for i in range(300)]
    df = spark.createDataFrame(data, "key string, value long").repartition(5)
    found = {r.key: r.place for r in ordering.rank_desc(df, "value", "key", "place").collect()}
    low = -1
    amounts = [low if v is None else v for _, v in data]
    assert found == {
        k: 1 + sum(a > (low if v is None else v) for a in amounts) for k, v in data
    }


def test_repeat_rows_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ordering, "COPIES_PER_CHUNK", 10)
    df = spark.createDataFrame([("a", 1), ("b", 95), ("c", 0), (None, 20)], "id string, n long")
    found = ordering.repeat_rows(df, "n", "i").collect()
    by_id = {k: sorted(r.i for r in found if r.id == k) for k in ("a", "b", "c", None)}
    assert by_id == {"a": [0], "b": list(range(95)), "c": [], None: list(range(20))}


PROBS = {"q1": 0.25, "median": 0.5, "q3": 0.75}


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 1000, 30_000])
def test_quantiles(spark, size):
    generator = np.random.default_rng(size)
    data = {
        "spread": generator.normal(0, 1e6, size),
        "ties": generator.integers(0, 3, size).astype(float),
        "heavy": np.where(generator.random(size) < 0.4, 5.0, generator.pareto(0.5, size)),
    }
    rows = [tuple(float(v[i]) for v in data.values()) for i in range(size)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(4)
    found = {r["column"]: r for r in ordering.exact_quantiles(df, PROBS).collect()}
    for column, numbers in data.items():
        expected = np.quantile(numbers, list(PROBS.values()))
        assert [found[column][q] for q in PROBS] == pytest.approx(expected, rel=1e-12)


def test_quantiles_with_a_coarse_sketch(spark, monkeypatch):
    """Wide brackets give the same values."""
    monkeypatch.setattr(ordering, "KLL_SIZE", 8)
    monkeypatch.setattr(ordering, "KLL_ERROR", 0.01)
    numbers = np.random.default_rng(3).exponential(10, 5000)
    df = spark.createDataFrame([(float(v),) for v in numbers], "v double").repartition(4)
    found = ordering.exact_quantiles(df, PROBS).first()
    assert [found[q] for q in PROBS] == pytest.approx(np.quantile(numbers, [0.25, 0.5, 0.75]))


def test_quantiles_of_missing_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None)], "none double, one double")
    found = {r["column"]: r for r in ordering.exact_quantiles(df, PROBS).collect()}
    assert [found["none"][q] for q in PROBS] == [None] * 3
    assert [found["one"][q] for q in PROBS] == [1.0] * 3


@pytest.mark.parametrize("most", [100_000, 50, 3])
def test_sum_of_the_largest(spark, most):
    """By one ordering, and by brackets that close in on the n-th value; ties count as far as needed."""
    generator = np.random.default_rng(11)
    columns = {
        "plain": np.round(generator.normal(0, 100, 3000), 2),
        "ties": np.round(generator.integers(0, 40, 3000) / 4, 2),
        "heavy": np.round(np.where(generator.random(3000) < 0.5, 7.0, generator.exponential(50, 3000)), 2),
    }
    for numbers in columns.values():
        df = spark.createDataFrame([(Decimal(str(v)),) for v in numbers], "v decimal(18,2)").repartition(3)
        for n in (1, 7, 600, 2999, 3000):
            want = sum(sorted((Decimal(str(v)) for v in numbers), reverse=True)[:n])
            if most == 100_000 or n == 600:
                assert ordering.sum_of_largest(df, "v", n, most).first().total == want
