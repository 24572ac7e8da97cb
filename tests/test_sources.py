import numpy as np

from lumenframe.sources import images
from lumenframe.streaming import windowed_histogram

SF = "/root/testdata/sf0.001"


def test_bmp_round_trip(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 256, (5, 7)).astype(np.uint8)
    (tmp_path / "a.bmp").write_bytes(images.encode(5, 7, a.tobytes()))
    (tmp_path / "b.pgm").write_bytes(b"P5\n# made\n7 5\n255\n" + a.tobytes())
    (tmp_path / "c.bmp").write_bytes(b"BMbroken")
    read = images.read_images(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r for r in read.collect()}
    assert bytes(got["a.bmp"]["px"]) == bytes(got["b.pgm"]["px"]) == a.tobytes() and got["c.bmp"]["problem"]
    long = images.pixels(read)
    assert sorted((r["y"], r["x"], r["v"]) for r in long.filter("path like '%a.bmp'").collect()) == [(y, x, int(a[y, x])) for y in range(5) for x in range(7)]
    again = images.packed(long.filter("path like '%a.bmp'"), "path").first()
    assert images.decode(bytes(again["bmp"])) == (5, 7, a.tobytes())


def test_markup(spark, tmp_path):
    (tmp_path / "m.txt").write_text("eye1 100 110 40 101 111 120\nbroken line\neye2 1 2 3 4 5 x\n")
    assert [tuple(r) for r in images.read_markup(spark, str(tmp_path)).collect()] == [("eye1", 100, 110, 40, 101, 111, 120)]


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    q = windowed_histogram(stream).writeStream.outputMode("complete").format("memory").queryName("hist").start()
    try:
        q.processAllAvailable()
        got = spark.sql("select * from hist")
        assert got.exceptAll(windowed_histogram(batch)).count() == 0 and got.agg({"n": "sum"}).first()[0] == batch.count()
    finally:
        q.stop()
