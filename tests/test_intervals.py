import random

from conftest import rows

from skyquarry.operators.intervals import periods_and_gaps


def plain(data):
    out, by = set(), {}
    for a, b, s, e in data:
        if None not in (a, b, s, e) and s <= e:
            by.setdefault((a, b), []).append((s, e))
    for k, spans in by.items():
        start = end = None
        for s, e in sorted(spans):
            if end is None or s > end:
                if end is not None:
                    out |= {(*k, "period", start, end), (*k, "gap", end, s)}
                start, end = s, e
            end = max(end, e)
        out.add((*k, "period", start, end))
    return out


def test_against_plain_version(spark):
    rnd = random.Random(5)
    data = [(rnd.choice("pq"), rnd.choice(["hot"] * 8 + ["x", "y"]), s, s + rnd.choice([0, 3, 10, 200])) for s in (rnd.randrange(20_000) for _ in range(3000))]
    df = spark.createDataFrame(data, "a string, b string, s long, e long")
    got = rows(periods_and_gaps(df, ("a", "b"), "s", "e"))
    assert len(got) == len(set(got)) and set(got) == plain(data)


def test_one_entity_over_many_partitions(spark):
    data = [("p", "t", i, 5000 if i == 3 else i + 1) for i in range(0, 9000, 3)]
    df = spark.createDataFrame(data, "a string, b string, s long, e long").repartition(7)
    assert set(rows(periods_and_gaps(df, ("a", "b"), "s", "e"))) == plain(data)


def test_edges(spark):
    data = [("p", None, 1, 2), (None, "t", 1, 2), ("p", "t", None, 2), ("p", "t", 5, 4), ("p", "t", 7, 7), ("p", "t", 7, 7), ("p", "", 1, 9), ("p", "t", 8, 9), ("p", "t", 9, 12)]
    df = spark.createDataFrame(data, "a string, b string, s long, e long").selectExpr("*", "1 as part", "2 as label", "3 as kind")
    assert set(rows(periods_and_gaps(df, ("a", "b"), "s", "e"))) == plain(data)
    assert periods_and_gaps(df.limit(0), ("a", "b"), "s", "e").count() == 0
