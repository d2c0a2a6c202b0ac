from test_archive import header, image, kv

from skyquarry.sources import fits


def test_files_with_many_units_are_read_whole(spark, tmp_path):
    primary = header(kv("SIMPLE", "T"), kv("BITPIX", "8"), kv("NAXIS", "0"))
    path = tmp_path / "many.fits"
    path.write_bytes(primary + b"".join(image(1, f"SCI{k}", [k, 2, 3, 4]) for k in range(1, 71)))
    headers = fits.read_headers(spark, str(path)).orderBy("ext_index").collect()
    assert [r.extname for r in headers] == [None, *(f"SCI{k}" for k in range(1, 71))]
    found = fits.planes(spark.read.format("binaryFile").load(str(path))).orderBy("ext_index").collect()
    assert [(r.ext_index, r.pixels[0]) for r in found] == [(k, k + 1) for k in range(1, 71)]
    assert fits.read_headers(spark, str(path), maxHeaders="64").count() == 64
