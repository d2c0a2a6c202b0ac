"""All queries against their SQL on the smallest tables, and the shape of the rest."""

import math
import subprocess
import sys
from collections import Counter
from pathlib import Path

import __spark_entry__ as entry
import pytest

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, data, duck, name):
    folder = data()
    df = QUERIES[name](spark, folder)
    got = Counter(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    want = duck(folder).execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == Counter(tuple(norm(r[columns.index(c)]) for c in sorted(columns)) for r in want.fetchall())


FOUND = {
    "p1_found": ["obsid", "field", "pos", "item"],
    "p2_found": ["kind", "id_a", "id_b"],
    "p3_found": ["obsid", "field", "donor"],
    "p4_found": ["tab", "rec_key", "lo_cnm", "hi_cnm"],
    "p5_found": ["field", "rec_id", "utc_ms"],
    "p7_found": ["proposal_id", "target_name", "kind", "start_s", "end_s"],
}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_found_columns(spark, data, name):
    df = QUERIES[name](spark, data())
    assert df.columns == FOUND[name]
    found = df.collect()
    assert found and len(found) == len(set(found))


def test_entry(spark, data):
    data()
    assert entry.entry(spark).count() > 0


def test_core_stands_alone():
    """Nothing outside the subpackage llm imports it, and the core works without it."""
    root = Path(__file__).resolve().parents[1]
    for f in (root / "skyquarry").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text().replace("tagged llm", ""), f
    code = "import sys; sys.modules['skyquarry.llm'] = None; import __spark_entry__ as e; assert 'p7_found' in e.queries() and 'p8_ids' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
