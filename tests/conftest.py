import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("SKYQUARRY_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from skyquarry.session import build

    session = build("local[4]", 4, spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    def folder(sf="sf0.001"):
        path = f"{DATA}/{sf}"
        if not os.path.isdir(path):
            pytest.skip("no test data")
        return path

    return folder


@pytest.fixture(scope="session")
def duck():
    """duck(folder) -> function that runs SQL over the folder's tables."""
    import duckdb

    def over(folder):
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for f in os.listdir(folder):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
        return con

    return over


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
