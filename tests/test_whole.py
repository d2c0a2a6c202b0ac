"""Queries over whole tables, with the rows that an earlier filter of query and SQL left out.

The SQL here has no such filter; the registered SQL of these queries still has it.
"""

from collections import Counter

import pytest
from test_queries import QUERIES, norm

from skyquarry.catalog import OBS
from skyquarry.operators import groups


@pytest.fixture(scope="module")
def same(spark, data, duck):
    """same(query, SQL): equal rows; gives the query's."""

    def check(name, sql):
        df = QUERIES[name](spark, data())
        got = Counter(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
        want = duck(data()).execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == Counter(tuple(norm(r[columns.index(c)]) for c in sorted(columns)) for r in want.fetchall())
        return got

    return check


def test_units_without_bitpix_are_sized(same, duck, data):
    got = same("fits_data_size", "SELECT DISTINCT header_id, CAST(CASE WHEN bitpix IN (8, 16, 32, 64, -32, -64) AND ext_index IS NOT NULL THEN abs(bitpix) // 8 * 1024 * (ext_index + 1) ELSE -1 END AS BIGINT) AS bytes FROM fits_headers")
    (units,) = duck(data()).execute("SELECT count(DISTINCT header_id) FROM fits_headers").fetchone()
    assert len({h for _, h in got}) == units and any(b == -1 for b, _ in got)


def test_locators_with_escapes_are_decoded(spark, data):
    from urllib.parse import unquote

    folder = data()
    uris = {r.datauri for r in spark.read.parquet(f"{folder}/caom_products.parquet").where("datauri is not null").select("datauri").collect()}
    got = [tuple(r) for r in QUERIES["url_normalise"](spark, folder).collect()]
    assert sorted(got) == sorted((u, unquote(u.replace("&amp;", "&")).lower()) for u in uris) and any("%" in u for u in uris)


def test_locators_of_a_small_table(spark, tmp_path):
    uris = ["mast:HST/product/hst%5F1001", "mast:HST/product/hst_1001", "a%20B+c&amp;d", "50%zz", None]
    spark.createDataFrame([(u,) for u in uris], "datauri string").write.parquet(f"{tmp_path}/caom_products.parquet")
    got = {r.datauri: r.locator for r in QUERIES["url_normalise"](spark, str(tmp_path)).collect()}
    assert got == {uris[0]: "mast:hst/product/hst_1001", uris[1]: "mast:hst/product/hst_1001", uris[2]: "a b+c&d", uris[3]: "50%zz"}


def test_closest_epoch_of_all_observations(same, duck, data):
    got = same("closest_epoch", OBS + ", u AS (SELECT *, coalesce(isfinite(t_min) AND t_min < 1e6, false) AS ok FROM obs), m AS (SELECT quantile_cont(t_min, 0.5) AS epoch FROM u WHERE ok AND t_min > 0) SELECT filters, obsid FROM (SELECT *, row_number() OVER (PARTITION BY filters ORDER BY CASE WHEN ok THEN abs(t_min - epoch) ELSE 'inf'::DOUBLE END, obsid) AS rn FROM u, m) WHERE rn = 1")
    (texts,) = duck(data()).execute("SELECT count(*) FROM (SELECT DISTINCT filters FROM caom_obs)").fetchone()
    assert len(got) == texts


def test_closest_epoch_with_unusable_starts(spark):
    nan = float("nan")
    starts = [("a", 1, nan), ("a", 2, 58000.0), ("b", 4, 1e20), ("b", 3, nan), ("b", 5, None), ("c", 7, nan), ("c", 6, None), ("d", 8, 58010.0), ("e", 9, 1e20), ("e", 10, -999.0), ("f", 11, 58020.0)]
    got = groups.closest_epoch(spark.createDataFrame(starts, "filters string, obsid long, t_min double"))
    assert sorted((r.filters, r.obsid) for r in got.collect()) == [("a", 2), ("b", 3), ("c", 6), ("d", 8), ("e", 10), ("f", 11)]
    late = spark.createDataFrame([("x", 1, 10.0), ("x", 2, 20.0), ("x", 3, 30.0), ("y", 4, nan), ("y", 5, 1e20), ("y", 6, float("inf"))], "filters string, obsid long, t_min double")
    assert {r.obsid for r in groups.closest_epoch(late).collect()} == {2, 4}


def test_filters_with_tabs_get_a_path_part(same):
    got = same("path_sanitise", OBS + r"SELECT DISTINCT filters, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim(filters), '[^A-Za-z0-9._-]', '_', 'g'), '__+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'none') AS part FROM obs WHERE filters IS NOT NULL")
    assert any("\t" in f for f, _ in got)


def test_path_parts_of_a_small_table(spark, tmp_path):
    want = {"F1\tF2": "F1_F2", "\tg\t": "g", " \t ": "none", "a\t\tb c": "a_b_c", "r": "r"}
    rows = [(i, f, None) for i, f in enumerate([*want, None])]
    spark.createDataFrame(rows, "obsid long, filters string, ingested_at timestamp").write.parquet(f"{tmp_path}/caom_obs.parquet")
    assert {r.filters: r.part for r in QUERIES["path_sanitise"](spark, str(tmp_path)).collect()} == want


def test_words_of_all_languages_are_counted(same):
    got = same("keyword_frequency", r"SELECT word AS keyword, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}[\p{L}\p{M}]*')) AS word FROM documents) GROUP BY word")
    assert any(not word.isascii() for word, _ in got)


def test_words_of_a_small_table(spark, tmp_path):
    texts = ["Geprüft, geprüft; días 42", "観測ログ λ_1 слово", "résumé हिन्दी", None, ""]
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.keyword: r.n for r in QUERIES["keyword_frequency"](spark, str(tmp_path)).collect()}
    assert got == {"geprüft": 2, "días": 1, "観測ログ": 1, "λ": 1, "слово": 1, "résumé": 1, "हिन्दी": 1}
