import pytest
from conftest import rows
from pyspark.sql import functions as F

from skyquarry.operators.units import to_common_unit, unit_of


@pytest.mark.parametrize(
    "text, want",
    [("nm", ("nm", 1)), ("[NM]", ("nm", 1)), ("0.1 nm", ("nm", 0.1)), ("1e-10 m", ("m", 1e-10)), ("10^-18 m", ("m", 1e-18)), ("10^3 nm", ("nm", 1e3)), ("A (vac)", ("A", 1)), ("Å", ("A", 1)),
     ("ANGSTROM", ("A", 1)), ("µm", ("um", 1)), ("μm", ("um", 1)), ("Micron", ("um", 1)), ("metres", ("m", 1)), ("cm^-1", ("cm-1", 1)), ("1/cm", ("cm-1", 1)), ("cm-1", ("cm-1", 1)), ("freq/GHz", ("GHz", 1)),
     ("energy (keV)", ("keV", 1)), ("ev", ("eV", 1)), ("terahertz", ("THz", 1)), ("lambda_p [nm], preliminary", ("nm", 1)), ("delivered in Å", ("A", 1)), ("checked", (None, None)), ("see handbook", (None, None)), ("", (None, None)), (None, (None, None))],
)
def test_unit_of(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(unit_of(F.col("t")).alias("u")).first().u
    assert got.unit == want[0] and (got.times == want[1] or got.times == pytest.approx(want[1], rel=1e-12))


def convert(df):
    return to_common_unit(df, "id", F.col("dev"), F.col("at"), F.col("lo"), F.col("hi"), F.col("unit"))


def test_decodes_unlabelled_rows_by_level(spark):
    scale = {"nm": 1, "A": 10, "um": 1e-3, "m": 1e-9}
    data = []
    for dev, level in (("red", 640.0), ("ir", 4400.0)):
        for i in range(60):
            unit = list(scale)[i % 4]
            low, high = level * 0.95 * scale[unit], level * 1.05 * scale[unit]
            data.append((len(data), dev, float(i), low, high, unit if i % 3 else None))
    got = convert(spark.createDataFrame(data, "id long, dev string, at double, lo double, hi double, unit string")).toPandas().set_index("id")
    for i, dev, _, low, _, unit in data:
        level = 640.0 if dev == "red" else 4400.0
        assert got.lo_nm[i] == pytest.approx(level * 0.95) and got.hi_nm[i] == pytest.approx(level * 1.05)
        assert got.source[i] == ("text" if unit else "sequence")


def test_edges(spark):
    nan = float("nan")
    data = [(1, "d", 1.0, 5.0, 4.0, "nm"), (1, "d", 1.0, 5.0, 4.0, "nm"), (2, "d", 1.0, None, 4.0, "nm"), (3, "d", 1.0, nan, 4.0, "nm"), (4, "d", 1.0, 0.0, 4.0, "nm"), (5, None, None, 1.0, 2.0, None), (None, "d", 1.0, 1.0, 2.0, "nm"), (6, "d", 1.0, 3.0e5, 4.0e5, "GHz")]
    df = spark.createDataFrame(data, "id long, dev string, at double, lo double, hi double, unit string").selectExpr("*", "1 as rid", "2 as level", "3 as chain")
    got = {r.id: r for r in convert(df).collect()}
    assert set(got) == {1, 5, 6}
    assert (got[1].lo_nm, got[1].hi_nm, got[1].own) == (4.0, 5.0, True) and got[5].unit is None and got[5].lo_nm is None
    assert got[6].lo_nm == pytest.approx(2.99792458e8 / 4e5) and not got[6].own
    assert rows(convert(df.limit(0))) == []


#: At this wavelength a value in nm and the same value in GHz are one: only the sequence tells them apart.
BOTH = 2.99792458e8**0.5


def stretches(shuffled=False):
    """A device that records in nm, then in GHz, then in nm again; every fourth record has its unit written."""
    import random

    at = list(range(400))
    if shuffled:
        random.Random(5).shuffle(at)
    return [(i, "d", float(at[i]), BOTH * 0.99, BOTH / 0.99, ("GHz" if 100 <= i < 300 else "nm") if i % 4 == 0 else None) for i in range(400)]


SCHEMA = "id long, dev string, at double, lo double, hi double, unit string"


def units_found(spark, data):
    return {r.id: r.unit for r in convert(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()}


def test_the_sequence_decides(spark):
    got = units_found(spark, stretches())
    right = sum(got[i] == ("GHz" if 100 <= i < 300 else "nm") for i in range(400))
    assert right >= 394
    got = units_found(spark, stretches(shuffled=True))
    assert sum(got[i] == ("GHz" if 100 <= i < 300 else "nm") for i in range(400)) < 380


def test_a_run_over_many_partitions(spark):
    """One label decides a run that fills whole partitions, from either side."""
    data = [(i, "a", float(i), BOTH * 0.99, BOTH / 0.99, "GHz" if i == 0 else None) for i in range(600)]
    data += [(1000 + i, "b", float(i), BOTH * 0.99, BOTH / 0.99, "GHz" if i == 599 else None) for i in range(600)]
    data += [(2000 + i, "c", float(i), BOTH * 0.99, BOTH / 0.99, "nm" if i < 300 else None) for i in range(600)]
    got = units_found(spark, data)
    assert {got[i] for i in range(600)} == {"GHz"} == {got[1000 + i] for i in range(600)} and {got[2000 + i] for i in range(600)} == {"nm"}


def test_parts_equal_one_chain(spark):
    """Partitions with carried summaries decode what one chain over all rows does."""
    import random

    rng = random.Random(9)
    data = []
    for dev in ("p", "q"):
        for i in range(500):
            unit = rng.choice(["nm", "A", "GHz"])
            v = BOTH * rng.uniform(0.99, 1.01) * (10 if unit == "A" else 1)
            data.append((len(data), dev, float(i), v * 0.99, v / 0.99, unit if rng.random() < 0.1 else None))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    many = units_found(spark, data)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    one = units_found(spark, data)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert many == one


def test_a_level_that_drifts(spark):
    data = []
    for i in range(600):
        level = 10 ** (2.5 + i / 400)
        scale = (1, 10, 1e-3)[i % 3]
        data.append((i, "d", float(i), level * 0.99 * scale, level / 0.99 * scale, ("nm", "A", "um")[i % 3] if i % 2 else None))
    got = units_found(spark, data)
    assert all(got[i] == ("nm", "A", "um")[i % 3] for i in range(600))
