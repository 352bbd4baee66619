"""Files written and read back."""

import gzip
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.sources import grids, mbtiles, vectors
from tilewright.streaming import logs, tail


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    mbtiles.register(spark)
    vectors.register(spark)


def test_compact_archive(spark, tmp_path):
    path = str(tmp_path / "a.mbtiles")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE metadata (name TEXT, value TEXT)")
        db.execute("INSERT INTO metadata VALUES ('format', 'pbf')")
        db.execute("CREATE TABLE tiles_data (tile_data_id INTEGER PRIMARY KEY, tile_data BLOB)")
        db.execute("CREATE TABLE tiles_shallow (zoom_level INT, tile_column INT, tile_row INT, tile_data_id INT)")
        db.executemany("INSERT INTO tiles_data VALUES (?, ?)", [(1, b"a" * 100), (2, b"b" * 200)])
        db.executemany("INSERT INTO tiles_shallow VALUES (?, ?, ?, ?)", [(5, 0, 0, 1), (5, 1, 0, 1), (6, 0, 0, 2), (6, 1, 0, 1)])
    t = spark.read.format("mbtiles").load(path)
    assert t.groupBy("zoom_level").agg(F.sum(F.length("tile_data"))).orderBy("zoom_level").collect() == [(5, 200), (6, 300)]
    assert t.where("zoom_level = 6 AND tile_column = 0").count() == 1
    assert spark.read.format("mbtiles").option("table", "metadata").load(path).collect() == [("format", "pbf")]


def test_archive_round_trip(spark, tmp_path):
    path = str(tmp_path / "b.mbtiles")
    t = spark.range(50).select(F.lit(7).alias("zoom_level"), F.col("id").alias("tile_column"), (F.col("id") % 5).alias("tile_row"), F.col("id").cast("string").cast("binary").alias("tile_data"))
    t.repartition(3).write.format("mbtiles").option("metadata.format", "pbf").mode("overwrite").save(path)
    assert sorted(map(tuple, spark.read.format("mbtiles").load(path).collect())) == sorted(map(tuple, t.collect()))
    assert [p.name for p in tmp_path.iterdir()] == ["b.mbtiles"]


def test_packing_blobs(spark):
    t = spark.createDataFrame([(1, bytearray(b"tile " * 200)), (2, None)], "id int, tile_data binary")
    packed = grids.pack_blobs(t)
    raw = {r.id: r.tile_data for r in packed.collect()}
    assert gzip.decompress(raw[1]) == b"tile " * 200 and raw[2] is None
    assert sorted(map(tuple, grids.unpack_blobs(packed).select("id", "tile_data").collect())) == sorted(map(tuple, t.collect()))


def test_hgt(spark, tmp_path):
    rows = np.array([[100, 100, 100], [150, -32768, 150], [200, 200, 200]], ">i2")
    (tmp_path / "N44E006.hgt").write_bytes(rows.tobytes())
    got = {(r.gx, r.gy): r.elev for r in grids.read_hgt(spark, str(tmp_path)).collect()}
    assert got[0, 0] == 100 and got[1, 1] is None and got[2, 2] == 200
    with pytest.raises(ValueError):
        grids.parse_hgt(b"12345")


def test_float_predictor():
    row = np.array([[0, 1.5, -3.25, 1234.5, 4808, -99999, 0.125, 42]], "f4")
    planes = row.astype(">f4").view(np.uint8).reshape(1, 8, 4).transpose(0, 2, 1).reshape(-1).astype(np.int16)
    coded = np.diff(planes, prepend=np.int16(0)).astype(np.uint8).tobytes()
    out = grids.decode_block(coded, 8, 1, "none", 3, nodata=-99999)
    assert np.isnan(out[0, 5]) and np.array_equal(np.delete(out, 5), np.delete(row, 5))
    assert grids.decode_block(b"", 8, 1, "none") is None


def test_png_tiles(spark):
    px = np.zeros((64, 64, 3), np.uint8)
    px[:] = (129, 244, 0)
    px[3, 5] = (128, 0, 0)
    raw = grids.encode_png(px)
    assert np.array_equal(grids.decode_png(raw), px)
    t = spark.createDataFrame([(0, 0, 0, bytearray(raw)), (0, 0, 1, bytearray(b"RIFF")), (0, 0, 2, None)], "zoom_level int, tile_column long, tile_row long, tile_data binary")
    got = grids.tile_pixels(t)
    assert got.count() == 64 * 64 and got.where("gx = 5 AND gy = 3").first().elev == 0 and got.where("gx = 0 AND gy = 0").first().elev == 500


def test_poly(spark, tmp_path):
    (tmp_path / "a.poly").write_text("area\n1\n 0 0\n 0 10\n 10 10\n 10 0\nEND\n!2\n 4 4\n 4 6\n 6 6\nEND\nEND\n")
    got = vectors.read_poly(spark, str(tmp_path)).collect()
    assert len(got) == 7 and {(r.ring_id, r.is_hole) for r in got} == {(0, 0), (1, 1)}
    for bad in ("a\n1\n 0 0\n 1 1\n 2 2\n", "a\n1\n 0 0\nEND\nEND\n", "a\nEND\n"):
        with pytest.raises(ValueError):
            vectors.parse_poly(bad)


def test_polyline(spark):
    assert [(lon, lat) for _, lon, lat in vectors.decode_polyline("_p~iF~ps|U_ulLnnqC_mqNvxq`@", 5)] == [(-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252)]
    assert spark.sql("SELECT * FROM decode_polyline('_p~iF~ps|U')").count() == 1


def test_partitions_of_like_bytes(spark, tmp_path):
    """Most bytes are in one zoom, a tenth of them in one column; partitions are like, and filters are the file's alone."""
    import random

    r = random.Random(1)
    path = str(tmp_path / "a.mbtiles")
    mbtiles.register(spark)
    sizes = {(z, x, y): r.randrange(200, 400) for z in range(8) for x in range(min(1 << z, 60)) for y in range(min(1 << z, 40))} | {(7, 5, y): 3000 for y in range(40)}
    db = mbtiles.new_archive(path)
    db.executemany("INSERT INTO tiles VALUES (?, ?, ?, ?)", [(*k, b"x" * n) for k, n in sizes.items()])
    db.execute("CREATE UNIQUE INDEX tile_index ON tiles (zoom_level, tile_column, tile_row)")
    db.commit()
    db.close()
    reader = mbtiles._Reader(path, "tiles", 50_000)
    parts = [sum(len(row[3]) for row in reader.read(p)) for p in reader.partitions()]
    assert sum(parts) == sum(sizes.values()) and max(parts) <= 2 * sum(parts) / len(parts) and len(parts) > 20
    t = spark.read.format("mbtiles").option("splitBytes", 50_000).load(path)
    assert {tuple(x)[:3]: len(x.tile_data) for x in t.collect()} == sizes
    for where in ("zoom_level >= 6 AND tile_column BETWEEN 3 AND 7", "zoom_level IN (2, 5) AND tile_row > 1", "zoom_level = 7 AND tile_column = 5 AND tile_row < 20", "tile_column < 0"):
        some = mbtiles.pushed(spark, "mbtiles", path).where(where)
        assert "Filter (" not in some._jdf.queryExecution().executedPlan().toString().replace("PushedFilters", "")
        plain = where.replace("AND 7", "and 7").replace(" AND ", " and ").replace("tile_column BETWEEN 3 and 7", "3 <= tile_column <= 7").replace("IN (", "in (").replace("tile_row = ", "tile_row == ").replace("zoom_level = ", "zoom_level == ").replace("tile_column = ", "tile_column == ")
        assert {tuple(x)[:3] for x in some.collect()} == {k for k in sizes if eval(plain, {}, dict(zip(mbtiles.ADDRESS, k)))}
    assert t.where("zoom_level = 2").unionByName(t).count() == len(sizes) + 16 and t.count() == len(sizes)
    sized = mbtiles.pushed(spark, "mbtiles", path, table="addresses").where("zoom_level > 4")
    assert {tuple(x)[:3]: x.nbytes for x in sized.collect()} == {k: n for k, n in sizes.items() if k[0] > 4}


def test_vector_tile(spark):
    def field(n, body):
        return bytes([n << 3 | 2, len(body)]) + body

    feature = field(2, b"\x00\x00\x01\x01") + b"\x18\x02"
    layer = field(1, b"road") + field(2, feature) + field(3, b"name") + field(3, b"lanes") + field(4, field(1, b"A1")) + field(4, b"\x20\x02") + b"\x28\x80\x20" + b"\x78\x02"
    rows = list(vectors.decode_tile(field(3, layer)))
    assert rows == [("road", 4096, 0, "line", "name", "A1"), ("road", 4096, 0, "line", "lanes", "2")]
    t = spark.createDataFrame([(bytearray(field(3, layer)),)], "tile_data binary")
    assert spark.sql("SELECT d.key FROM {t} t, LATERAL decode_tile(t.tile_data) d", t=t).count() == 2


def test_encoded_tiles():
    features = [("road", 2, [("name", "A1"), ("lanes", 2), ("toll", False), ("km", 1.5)]), ("poi", 1, []), ("road", 2, [("name", "A1"), ("level", -3), ("far", 1 << 40), ("deep", -(1 << 40)), ("é", "日")])]
    want = [("road", 4096, 0, "line", "name", "A1"), ("road", 4096, 0, "line", "lanes", "2"), ("road", 4096, 0, "line", "toll", "false"), ("road", 4096, 0, "line", "km", "1.5")]
    want += [("road", 4096, 1, "line", "name", "A1"), ("road", 4096, 1, "line", "level", "-3"), ("road", 4096, 1, "line", "far", str(1 << 40)), ("road", 4096, 1, "line", "deep", str(-(1 << 40))), ("road", 4096, 1, "line", "é", "日")]
    assert list(vectors.decode_tile(vectors.encode_tile(features))) == [*want, ("poi", 4096, 0, "point", None, None)]
    assert vectors.encode_tile([]) == b""


def test_double_value():
    assert vectors._value(b"\x19" + struct.pack("<d", 0.5)) == "0.5"


def follow(spark, tmp_path, make, name):
    """All rows written so far by a query over the growing logs, after it took what is new."""
    tail.register(spark)
    made = make(logs.parsed(spark.readStream.format("log_tail").load(str(tmp_path / "in")), "line"))
    made.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start().awaitTermination(120)
    return sorted((tuple(r)[0].rpartition("/")[2], *tuple(r)[1:]) for r in spark.read.schema(made.schema).parquet(str(tmp_path / name)).collect())


def test_growing_logs(spark, tmp_path):
    """Lines are taken once, when they are whole; a query that is started again goes on, with what it held."""
    (tmp_path / "in").mkdir()
    one, two = tmp_path / "in" / "1.log", tmp_path / "in" / "2.log"
    first = ["0:00:01 INF [a] - Starting...", "0:00:02 INF [a] -  read: [ 1 50% 3/s ]", "0:00:02 INF [a] -  read: [ 1 50% 3/s ]", "0:00:09 INF [a] - Finished in 8s cpu:3s", "noise"]
    one.write_text("\n".join(first) + "\n0:00:10 INF [b] - Fini")
    two.write_text("0:00:03 INF [a] -  read: [ 1 7% ]\r\n0:00:54 INF - FINISHED!\n")
    lines = lambda: follow(spark, tmp_path, lambda e: e.select("path", "offset", "line"), "lines")
    at = [sum(len(x) + 1 for x in first[:i]) for i in range(6)]
    assert lines() == [("1.log", at[i], x) for i, x in enumerate(first)] + [("2.log", 0, "0:00:03 INF [a] -  read: [ 1 7% ]"), ("2.log", 35, "0:00:54 INF - FINISHED!")]
    ends = lambda: [r[::2] for r in follow(spark, tmp_path, logs.run_durations, "ends")]
    changes = lambda: [(r[0], r[1], r[3]) for r in follow(spark, tmp_path, logs.percent_changes, "changes")]
    assert ends() == [("2.log", None)] and sorted(changes()) == [("1.log", "a", 50), ("2.log", "a", 7)]
    with one.open("a") as out:
        out.write("shed in 3m10s cpu:1s\n0:00:11 INF [a] - read: [ 50% ]\n0:00:12 INF [a] - read: [ 51% ]\n0:00:13 INF [a] - read: [ 50% ]\n0:00:54 INF - FINISHED!\n0:00:55 INF - FINISHED!\n")
    # One duration a run, of the last stage that ended, whatever the stage; the second end has none.
    assert ends() == [("1.log", "3m10s"), ("1.log", None), ("2.log", None)]
    assert sorted(c[2] for c in changes() if c[0] == "1.log") == [50, 50, 51]
    assert len(lines()) == 13 and lines() == lines()


def test_ranges_of_a_log_meet_at_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "_PART", 7)
    monkeypatch.setattr(tail, "_LOOK", 3)
    text = "a\n\nbb\n" + "x" * 30 + "\n" + "".join(f"line {i}\n" for i in range(20)) + "rest"
    (tmp_path / "a.log").write_text(text)
    reader = tail._Tail([str(tmp_path)])
    end = reader.latestOffset()
    got = [row for part in reader.partitions(reader.initialOffset(), end) for row in reader.read(part)]
    assert [r[2] for r in got] == text.split("\n")[:-1]
    assert all(text[at:].startswith(line + "\n") for _, at, line in got)
    assert reader.partitions(end, end) == []


def test_small_logs_share_a_task(tmp_path, monkeypatch):
    """Files are read in tasks of many bytes, not in one each, and looked at again only where they have grown."""
    for i in range(200):
        (tmp_path / f"{i}.log").write_text(f"line {i}\nmore\n")
    reader = tail._Tail([str(tmp_path)])
    first = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), first)
    assert len(parts) == 1
    assert sorted((r[0].rpartition("/")[2], r[2]) for r in reader.read(parts[0])) == sorted((f"{i}.log", x) for i in range(200) for x in (f"line {i}", "more"))
    with (tmp_path / "7.log").open("a") as out:
        out.write("new\nopen")
    looked = []
    whole = tail._whole_lines
    monkeypatch.setattr(tail, "_whole_lines", lambda fs, path, size: looked.append(path) or whole(fs, path, size))
    (part,) = reader.partitions(first, reader.latestOffset())
    assert [r[2] for r in reader.read(part)] == ["new"] and [p.rpartition("/")[2] for p in looked] == ["7.log"]


def test_held_durations(spark, monkeypatch):
    monkeypatch.setattr(logs, "_RUN", 3)
    kinds = ["run_end", "phase_end", "log", "zoom_end", "progress", "log", "log", "log", "run_end", "run_end", "phase_end", "phase_end", "run_end", "log", "phase_end"]
    rows = [(i, k, f"{i}s" if k in ("phase_end", "zoom_end") else None) for i, k in enumerate(kinds)]
    got = logs.held_durations(spark.createDataFrame(rows, "line_no long, event string, took string")).collect()
    assert {r.line_no: r.took for r in got} == {0: None, 8: "1s", 9: None, 12: "11s"}


def test_late_events(spark, tmp_path):
    """Pairs over two batches, and what comes after the watermark: it is left out of closed windows, and counted."""
    import datetime as dt

    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    schema = "event_id long, user_id long, ts timestamp, event_type string, value double"

    def run(make, name, mode):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = make(stream).writeStream.format("parquet" if mode == "append" else "noop").outputMode(mode).option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return query

    def batch(rows):
        spark.createDataFrame([(i, u, at(h), "a", 1.0) for i, u, h in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    pairs = lambda s: logs.pairs_within(s, s, "1 hour", "2 hours")
    counts = lambda s: logs.windowed_counts(s, "1 hour", "2 hours")
    batch([(1, 7, 0.0), (2, 7, 0.5), (3, 8, 0.6), (4, 7, 0.9)])
    run(pairs, "pairs", "append"), run(counts, "counts", "append")
    batch([(5, 7, 1.2), (6, 9, 50.0)])
    run(pairs, "pairs", "append"), run(counts, "counts", "append")
    batch([(7, 9, 50.5), (8, 8, 0.7)])  # the last is two days late
    run(pairs, "pairs", "append")
    late = sum(p["numRowsDroppedByWatermark"] for progress in run(counts, "counts", "append").recentProgress for p in progress["stateOperators"])
    got = {(r.first_id, r.second_id) for r in spark.read.parquet(str(tmp_path / "pairs")).collect()}
    assert got == {(1, 2), (1, 4), (2, 4), (2, 5), (4, 5), (6, 7)}
    assert late == 1
    closed = {(r.start.hour, r.events) for r in spark.read.parquet(str(tmp_path / "counts")).collect()}
    assert closed == {(0, 4), (1, 1)}


def test_event_windows(spark, data):
    e = spark.read.parquet(f"{data}/events.parquet")
    assert logs.windowed_counts(e).agg(F.sum("events")).first()[0] == e.count() == logs.sessions(e).agg(F.sum("events")).first()[0]
