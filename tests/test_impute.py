import numpy as np
from pyspark.sql import functions as F

from skyquarry.operators.impute import chow_liu, fill_missing, posteriors


def test_tree_and_messages_against_enumeration():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 3, 4000)
    b = np.where(rng.random(4000) < 0.9, a, rng.integers(0, 3, 4000))
    c = np.where(rng.random(4000) < 0.9, b, rng.integers(0, 3, 4000))
    cols = [a, b, c]
    single = [np.bincount(x, minlength=3).astype(float) for x in cols]
    joint = {}
    for i in range(3):
        for j in range(i + 1, 3):
            joint[i, j] = np.zeros((3, 3))
            np.add.at(joint[i, j], (cols[i], cols[j]), 1)
    tree = chow_liu(["a", "b", "c"], [3, 3, 3], single, joint)
    assert tree.parent == [-1, 0, 1]
    got = posteriors(tree, np.array([[-1, -1, 2], [0, -1, 0], [-1, -1, -1]]), [0, 1])
    full = np.einsum("a,ab,bc->abc", tree.prior[0], tree.given[1], tree.given[2])
    want = full[:, :, 2].sum(1) / full[:, :, 2].sum()
    assert np.allclose(got[0][0], want)
    want = full[0, :, 0] / full[0, :, 0].sum()
    assert np.allclose(got[1][1], want)
    assert np.allclose(got[0][2], tree.prior[0])


def fill(df):
    return fill_missing(df, "id", [F.col("g")], {"t": F.col("t")}, {"x": F.col("x")}, {"k": F.col("k")}, bins=8).toPandas()


def test_fills_from_group_and_kind(spark):
    data = [(i, f"g{i // 2}", float(i), float(i), "even" if i % 2 == 0 else "odd") for i in range(400)]
    data = [(i, g, None if i in (100, 200, 201) else t, x, k) for i, g, t, x, k in data]
    got = fill(spark.createDataFrame(data, "id long, g string, t double, x double, k string")).set_index("id")
    assert got.donor.to_dict() == {100: "group", 200: "none", 201: "none"}
    assert got.value[100] == 101.0 and abs(got.value[200] - 200) < 60 and (got.certainty > 0).all()


def test_edges(spark):
    schema = "id long, g string, t double, x double, k string"
    df = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (2, "a", None, 1.0, "k"), (None, "a", None, 1.0, "k"), (3, "a", None, 2.0, "z")], schema)
    got = fill(df.selectExpr("*", "1 as rid", "2 as grp", "3 as s"))
    assert sorted(zip(got.id, got.donor)) == [(1, "none"), (2, "none"), (3, "none")] and got.value.isna().all()
    assert len(fill(df.limit(0))) == 0
    assert len(fill(df.withColumn("t", F.lit(1.0)))) == 0


def test_a_repeated_record_is_no_donor_of_itself(spark):
    rows = [(i, f"g{i}", float(i), float(i), "k") for i in range(50)] + [(99, "alone", None, 5.0, "k")]
    df = spark.createDataFrame(rows, "id long, g string, t double, x double, k string")
    got = fill(df.unionAll(df))
    assert got.id.tolist() == [99] and got.donor.tolist() == ["none"]


def test_categories_are_filled(spark):
    """A category goes with its group; without one, with what it goes along with elsewhere."""
    rows = [(i, f"g{i // 4}", ["red", "blue"][i // 4 % 2], float(i // 4 % 2)) for i in range(400)]
    rows = [(i, None if i >= 390 else g, None if i in (8, 13) or i >= 390 else c, x) for i, g, c, x in rows]
    df = spark.createDataFrame(rows, "id long, g string, c string, x double")
    got = fill_missing(df, "id", [F.col("g")], {"c": F.col("c")}, {"x": F.col("x")}, {}).toPandas().set_index("id")
    assert got.category.to_dict() == {i: ["red", "blue"][i // 4 % 2] for i in [8, 13, *range(390, 400)]}
    assert got.donor[8] == got.donor[13] == "group" and got.donor[395] == "none"


def test_held_out_times(spark, data):
    """A twentieth of the known start times is hidden; how far the filled ones are off, by donor."""
    from skyquarry.functions import keys
    from skyquarry.problems import good_time
    from skyquarry.session import table, usable

    obs = table(spark, data("sf0.01"), "caom_obs").dropDuplicates(["obsid"])
    times = {f: F.when(good_time(f), F.col(f)) for f in ("t_min", "t_max", "t_obs_release")}
    hidden = good_time("t_min") & (F.pmod(F.xxhash64("obsid"), F.lit(20)) == 0)
    masked = obs.withColumn("true", F.when(hidden, F.col("t_min"))).withColumn("t_min", F.when(~hidden, F.col("t_min")))
    got = fill_missing(
        masked, "obsid", [keys.mission(F.col("obs_collection")), keys.group_key(F.col("obs_collection"), F.col("obs_id"))], times,
        {"ingested": F.unix_micros("ingested_at") / 86_400e6, "t_exptime": F.when(usable("t_exptime") & (F.col("t_exptime") > 0), F.col("t_exptime"))},
        {c: F.col(c) for c in ("obs_collection", "proposal_id", "proposal_type", "calib_level", "dataproduct_type")},
    )
    both = got.where("field = 't_min'").join(masked.where("true is not null").select("obsid", "true"), "obsid").toPandas()
    off = (both.value - both.true).abs().groupby(both.donor).describe(percentiles=[0.5, 0.75])
    print(off.to_string())
    assert off.loc["group", "50%"] < 0.05 and off.loc["none", "50%"] < 150
