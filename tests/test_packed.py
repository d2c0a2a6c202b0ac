import re

import pandas as pd
from conftest import rows

from skyquarry.operators.packed import atoms, split_packed
from skyquarry.problems import p1_found


def plain(text, seps):
    """Straight splitter with given separators; quoted spans are atomic."""
    text = text.strip(" \t")
    while len(text) > 1 and text[0] + text[-1] in ("[]", "()", "{}"):
        text = text[1:-1].strip(" \t")
    out = []
    for part in re.findall(rf"""\s*"(?:[^"]|"")*"\s*(?=[{seps}]|$)|\s*'(?:[^']|'')*'\s*(?=[{seps}]|$)|[^{seps}]+""", text):
        part = part.strip(" \t")
        if len(part) > 1 and part[0] == part[-1] and part[0] in "\"'":
            part = part[1:-1].replace(part[0] * 2, part[0]).strip()
        if part:
            out.append(part)
    return out


def test_whole_table_against_plain_splitter(spark, data):
    folder = data("sf0.01")
    obs = spark.read.parquet(f"{folder}/caom_obs.parquet").select("obsid", "filters", "instrument_name").distinct().toPandas()
    want = set()
    for field, seps in (("filters", ";,|+&\t/"), ("instrument_name", ";,|+&\t")):
        for rid, text in zip(obs.obsid, obs[field]):
            items = plain(text, seps) if isinstance(text, str) else []
            if len(items) > 1:
                want |= {(rid, field, i, x) for i, x in enumerate(items, 1)}
    assert set(rows(p1_found(spark, folder))) == want


def test_atoms():
    assert atoms('["a;b" ; c]') == ([("a;b", True), ("c", False)], [";"])
    assert atoms('"SLIT 5""" , x') == ([('SLIT 5"', True), ("x", False)], [","])
    assert atoms(" ;; ") == ([], [])
    assert atoms("a , , b") == ([("a", False), ("b", False)], [",,"])


def test_learns_what_separates(spark):
    """A slash joins where its parts never stand alone, and separates where they do."""
    one = [(i, f"CAM/{'AB'[i % 2]}" + (";AUX" if i % 3 else ""), "x") for i in range(60)]
    two = [(100 + i, ["red", "blue", "green", "red/blue", "blue/green"][i % 5], "y") for i in range(60)]
    df = spark.createDataFrame([(i, t if c == "x" else None, t if c == "y" else None) for i, t, c in one + two], "id long, a string, b string")
    found = split_packed(df, "id", ["a", "b"]).toPandas()
    assert set(found[found.field == "a"].item) == {"CAM/A", "CAM/B", "AUX"}
    assert set(found[found.field == "b"].item) == {"red", "blue", "green"}


def test_edges(spark):
    long = ";".join(f"f{i}" for i in range(3000))
    data = [(1, "a;b", "t"), (1, "a;b", "t"), (2, None, "t"), (3, "", "t"), (4, "  ", "t"), (5, ";;", "t"), (6, long, "t"), (None, "a;b", "t"), (7, "a;a", "t"), (8, "a", "t")]
    df = spark.createDataFrame(data, "id long, f string, text string").selectExpr("id", "f", "text", "1 as n", "2 as tid", "3 as field", "4 as item")
    found = split_packed(df, "id", ["f"]).toPandas()
    assert found[found.id == 1].sort_values("pos").item.tolist() == ["a", "b"]
    assert found[found.id == 7].sort_values("pos").item.tolist() == ["a", "a"]
    assert found[found.id == 6].shape[0] == 3000 and set(found.id) == {1, 6, 7}
    assert split_packed(df.limit(0), "id", ["f"]).count() == 0
    assert isinstance(found, pd.DataFrame)


def test_long_joins_have_no_limit(spark):
    """A name of four atoms over a character that never separates in the column stays whole."""
    data = [(i, "A/B/C/D" if i % 2 else "A/B/C/D;AUX") for i in range(40)] + [(100 + i, t) for i, t in enumerate(["AUX", "AUX;RED", "RED"] * 10)]
    found = split_packed(spark.createDataFrame(data, "id long, f string"), "id", ["f"]).toPandas()
    assert set(found.item) == {"A/B/C/D", "AUX", "RED"} and set(found[found.id == 2].item) == {"A/B/C/D", "AUX"}


def test_lattice_of_any_join_against_all_spans():
    """Posteriors and best path with few edges and the pass over all starts equal those with an edge for every span."""
    import random

    from skyquarry.operators.packed import CANDIDATES, Lattice, Model, spans

    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(2, 9)
        found = [(rng.choice(["a", "bb", "ccc", "F1"]), rng.random() < 0.15) for _ in range(n)]
        between = [rng.choice(["/", ";", "/", ";;"]) for _ in range(n - 1)]
        model = Model(50.0, dict.fromkeys(CANDIDATES, 0.5) | {"/": 0.01, ";": 0.6}, dict.fromkeys(CANDIDATES, 0.9))
        counts = {"a": 5, "a/bb": 7}
        edges = {s: [(i, j, v, inner, counts.get(v, 0)) for i, j, v, inner in spans(found, between, s)] for s in (2, n)}
        quoted = [q for _, q in found]
        few, all_ = (Lattice(n, between, quoted, edges[s], model, s) for s in (2, n))
        a = {(i, j): p for p, i, j, _, _ in few.expected()}
        b = {(i, j): p for p, i, j, _, _ in all_.expected()}
        assert all(abs(a.get(k, 0.0) - p) < 2e-6 for k, p in b.items())
        assert few.best() == all_.best()
