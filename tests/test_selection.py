"""Exact ranks against brute force, with ties, NULLs, skew and brackets that miss."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.operators import grounding, stats
from plumbline.plans import selection
from plumbline.sources import tables


def quantile(values, p):
    values = sorted(values)
    place = p * (len(values) - 1)
    low, high = values[int(place)], values[min(int(place) + 1, len(values) - 1)]
    return low + (high - low) * (place - int(place))


@pytest.fixture(scope="module")
def numbers():
    rng = random.Random(7)
    skewed = [rng.lognormvariate(0, 4) * rng.choice([-1, 1]) for _ in range(20000)]
    tied = [float(rng.choice([0, 0, 0, 1, 2, 2, 9])) for _ in range(20000)]
    hot = [5.0 if i % 3 == 0 else rng.random() for i in range(20000)]
    return skewed, tied, hot


def test_quantiles(spark, numbers):
    df = spark.createDataFrame([*zip(*numbers)], "a double, b double, c double").repartition(7)
    wanted = [(f"{c}{p}", c, p) for c in "abc" for p in (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)]
    found = selection.exact_quantiles(df, wanted)
    for label, c, p in wanted:
        assert found[label] == pytest.approx(quantile(numbers["abc".index(c)], p), rel=1e-12), label


def test_quantiles_narrow_in_several_rounds(spark, numbers, monkeypatch):
    monkeypatch.setattr(selection, "SMALL_BRACKET", 5)
    df = spark.createDataFrame([(x,) for x in numbers[0]], "a double")
    found = selection.exact_quantiles(df, [("m", "a", 0.5), ("q", "a", 0.9)])
    assert found == pytest.approx({"m": quantile(numbers[0], 0.5), "q": quantile(numbers[0], 0.9)})


@pytest.mark.parametrize("bounds", [(900, 950), (2, 5), (-7, 2000), (500, 500), (None, 499)])
def test_bounds_that_miss(spark, monkeypatch, bounds):
    first = []
    real = selection._Search.propose

    def wrong(self, grid, margin):
        if self.rank in first:
            return real(self, grid, margin)
        first.append(self.rank)
        self.left, self.right = bounds

    monkeypatch.setattr(selection._Search, "propose", wrong)
    monkeypatch.setattr(selection, "SMALL_BRACKET", 5)
    df = spark.range(1001).select(F.col("id").cast("double").alias("a"))
    assert selection.exact_quantiles(df, [("m", "a", 0.5)]) == {"m": 500.0}


def test_no_more_than_the_bound_is_ordered(spark, monkeypatch):
    """Half of the rows are zero and every wanted rank lies beside them."""
    monkeypatch.setattr(selection, "SMALL_BRACKET", 40)
    left = []
    real = selection._pick

    def seen(values, searches):
        left.extend(s.inside for s in searches.values())
        return real(values, searches)

    monkeypatch.setattr(selection, "_pick", seen)
    data = [0] * 3000 + list(range(1, 1501)) + list(range(-1500, 0))
    df = spark.createDataFrame([(x,) for x in data], "a long").repartition(4)
    ranks = [0, 1, 1499, 1500, 4499, 4500, 4501, 5999]
    found = selection.select_ranks(df, [selection.RankTarget(str(r), "a", lambda n, r=r: r, lambda n, r=r: r) for r in ranks])
    assert {r: found[str(r)][1] for r in ranks} == {r: sorted(data)[r] for r in ranks}
    assert max(left, default=0) <= 40


def test_values_keep_their_type(spark, monkeypatch):
    monkeypatch.setattr(selection, "SMALL_BRACKET", 3)
    big = [(1 << 60) + i for i in range(50)]
    exact = [Decimal(10) ** 25 + Decimal(i) / 100 for i in range(50)]
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(50)]
    words = [f"w{i:02}é" for i in range(50)]
    odd = [float(i) for i in range(40)] + [float("nan")] * 10
    df = spark.createDataFrame(
        [*zip(big, exact, days, words, odd)], "a long, b decimal(38,2), c date, d string, e double"
    ).repartition(3)
    for rank in (0, 1, 24, 48, 49):
        targets = [selection.RankTarget(c, c, lambda n: rank, lambda n: rank) for c in "abcde"]
        found = selection.select_ranks(df, targets)
        assert [found[c][1] for c in "abcd"] == [big[rank], exact[rank], days[rank], words[rank]]
        assert found["e"][1] == odd[rank] or rank >= 40 and found["e"][1] != found["e"][1]


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    assert selection.exact_quantiles(df, [("a", "a", 0.5), ("b", "b", 0.5)]) == {"a": 2.0, "b": None}


def test_cumulative_counts_with_a_hot_family(spark):
    rng = random.Random(3)
    rows = [("hot", float(rng.randrange(3000))) for _ in range(9000)]
    rows += [(f"f{i % 50}", rng.random()) for i in range(2000)] + [("tied", 1.0)] * 500
    found = selection.cumulative_counts(spark.createDataFrame(rows, "f string, v double"), ["f"], "v").collect()
    by_family = {}
    for f, v in rows:
        by_family.setdefault(f, []).append(v)
    assert len(found) == sum(len(set(v)) for v in by_family.values())
    for r in found:
        values = by_family[r["f"]]
        assert r["rows_through"] == sum(x <= r["v"] for x in values)
        assert r["rows"] == values.count(r["v"])
        assert r["family_rows"] == len(values)


def test_lookup_keeps_every_row(spark):
    big = spark.range(1000).select(F.lit(1).alias("k"), "id")
    found = selection.lookup(big, spark.createDataFrame([(1, "x"), (2, "y")], "k int, t string"), ["k"])
    assert found.where("t = 'x'").count() == 1000


@pytest.mark.parametrize("ascending", [True, False])
def test_pages_cover_the_table_once(spark, ascending, monkeypatch):
    monkeypatch.setattr(tables, "TOP_ROWS", 100)
    df = spark.range(0, 2100, 3).repartition(5)
    seen = []
    for number in range(1, 10):
        page = [r["id"] for r in tables.page(df, "id", number, 90, ascending).collect()]
        assert page == sorted(page, reverse=not ascending)
        seen += page
    assert sorted(seen) == list(range(0, 2100, 3))


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("kind", ["string", "timestamp", "timestamp_ntz", "double", "boolean", "long"])
def test_pages_are_the_same_at_every_depth(spark, kind, ascending, monkeypatch):
    """NULL keys, equal keys and copies of rows, with array columns: every row is on one page."""
    start = datetime(2024, 3, 1)
    key = {
        "string": lambda i: f"k{i:03}",
        "timestamp": lambda i: start + timedelta(microseconds=i),
        "timestamp_ntz": lambda i: start + timedelta(microseconds=i),
        "double": lambda i: i / 3 if i < 70 else float("nan"),
        "boolean": lambda i: i % 2 == 0,
        "long": lambda i: (1 << 60) + i,
    }[kind]
    rows = [(None if i % 4 == 0 else key(7 if i % 3 == 0 else i), [i // 2 % 9]) for i in range(90)]
    df = spark.createDataFrame(rows, f"k {kind}, a array<int>").repartition(3)
    pages = {}
    for depth in (1000, 12):
        monkeypatch.setattr(tables, "TOP_ROWS", depth)
        pages[depth] = [[str(r) for r in tables.page(df, "k", n, 11, ascending).collect()] for n in (1, 5, 9, 10)]
    assert pages[12] == pages[1000]
    assert [len(p) for p in pages[12]] == [11, 11, 2, 0]


def test_fingerprint_tells_rows_apart(spark):
    def of(rows, schema="a string, b string, c array<string>, d map<string,int>"):
        return tables.fingerprint(spark.createDataFrame(rows, schema)).first()["hash_sum"]

    assert of([("a|1=b", "c", [], {})]) != of([("a", "b|1=c", [], {})])
    assert of([("a", "", ["x"], {})]) != of([("a", "", ["y"], {})])
    assert of([("a", "", None, {})]) != of([("a", None, None, {})])
    assert of([("a", "", None, {"p": 1, "q": 2})]) == of([("a", "", None, {"q": 2, "p": 1})])


def test_texts_without_numbers_pass(spark):
    df = spark.createDataFrame([(1, "no number"), (2, None), (3, ""), (4, "77")], "id int, t string")
    store = spark.createDataFrame([(5.0,)], "v double")
    for tolerance in (0.01, 0.001):
        got = {r["id"]: (r["ungrounded"], r["passed"]) for r in grounding.number_lint(df, "t", ["id"], store, "v", tolerance).collect()}
        assert got == {1: (0, True), 2: (0, True), 3: (0, True), 4: (1, False)}


def test_trailing_run_with_text_ids(spark):
    """Of equal p-values at the edge some may pass, whatever the type of their ids."""
    rows = [("f", f"id{i}", 0.04 if i < 6 else 0.9 if i == 6 else 0.001) for i in range(10)]
    df = spark.createDataFrame(rows, "f string, h string, p double")
    got = stats.benjamini_hochberg(df, "p", ["f"], "h", variant="trailing").collect()
    assert sorted(r["h"] for r in got) == sorted(h for _, h, _ in rows) and set(got[0].asDict()) == {"f", "h", "p", "rejected"}
    ranked = sorted(p for _, _, p in rows)
    run = 0
    while run < 10 and ranked[9 - run] <= (10 - run) / 10 * 0.05:
        run += 1
    assert sum(r["rejected"] for r in got) == run
