"""Files, generated data, the wire format, the service."""

import struct
import threading

import pytest

from corvane import Engine
from corvane.sources import chunk_file, datagen, wire
from corvane.sources.parquet import read_table, write_table
from corvane.sources.zone_maps import ZoneMap, zone_maps
from corvane.types import Kind


def test_chunks_and_zone_maps(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(spark.range(0, 5000, 1, 1).selectExpr("id", "cast(id % 7 as string) s", "if(id < 10, null, id) n"), path, 2048)
    assert sorted(z.rows for z in zone_maps(path, "id")) == [904, 2048, 2048]
    assert read_table(spark, path).count() == 5000
    whole = zone_maps(path, "n")[0]
    for z in zone_maps(path, "n")[1:]:
        whole = whole.merged_with(z)
    assert whole == ZoneMap(10, 4999, 10, 5000)
    e = Engine(spark).register("t", path)
    (stats,) = e.scan_stats("SELECT id FROM t WHERE id > 4100 AND s = '3'")
    assert (stats.total_chunks, stats.pruned_chunks) == (3, 2) and stats.rows_produced <= 904


@pytest.mark.parametrize(("op", "value", "match"), [("=", 4, False), ("=", 5, True), ("<", 5, False), ("<=", 5, True), (">", 9, False), (">=", 9, True), ("!=", 5, True), ("=", "x", True), ("=", True, True)])
def test_zone_map_tests(op, value, match):
    assert ZoneMap(5, 9, 0, 10).may_match(op, value) is match
    assert ZoneMap(None, None, 10, 10).may_match(op, value) is False


def test_zone_map_contains():
    assert ZoneMap(5, 9, 0, 3).can_contain(5) and not ZoneMap(5, 9, 0, 3).can_contain(10) and ZoneMap(None, None, 3, 3).can_contain(1)


def test_generated_data_is_the_same_for_a_seed(spark):
    a, b = datagen.orders(spark, 1000, 50), datagen.orders(spark, 1000, 50).repartition(7)
    assert a.exceptAll(b).count() == 0
    r = a.selectExpr("min(amount)", "max(amount)", "max(customer_id)", "min(quantity)", "max(quantity)", "count(distinct status)", "count(distinct region)").first()
    assert r[0] >= 5 and r[1] <= 2000 and r[2] < 50 and (r[3], r[4], r[5], r[6]) == (1, 20, 4, 5)
    assert datagen.customers(spark, 3).orderBy("id").first()["name"] == "customer_0"


COLUMNS = [
    ("i", chunk_file.INT32, [10, 20, None, 40, 50, -1]), ("l", chunk_file.INT64, [1, None, 1 << 60, 3, 4, 5]), ("d", chunk_file.DOUBLE, [1.5, None, 2.5, 0.0, -1.0, 9.0]),
    ("b", chunk_file.BOOL, [True, False, None, True, True, False]), ("p", chunk_file.VARCHAR, ["alpha", "beta", None, "delta", "", "é"]),
    ("q", chunk_file.VARCHAR, ["US", "IN", "US", None, "IN", "DE"]), ("r", chunk_file.VARCHAR, ["A", "A", None, "A", "B", "B"]),
]
ENCODINGS = {"q": chunk_file.DICTIONARY, "r": chunk_file.RUNS}


def test_chunk_file_round_trip(spark, tmp_path):
    path = str(tmp_path / "t.cef")
    chunk_file.write_chunks(path, COLUMNS, 4, ENCODINGS)
    footer = chunk_file.read_footer(path)
    assert all(c.offset % 64 == 0 for col in footer for c in col.chunks)
    assert footer[0].chunks[0].zone == ZoneMap(10, 40, 1, 4) and footer[6].chunks[0].runs == 3 and footer[5].chunks[0].dictionary == ("US", "IN")
    chunk_file.register(spark)
    frame = spark.read.format("corvane_chunks").load(path)
    assert [tuple(r) for r in frame.collect()] == list(zip(*[v for _, _, v in COLUMNS], strict=True))
    e = Engine(spark).register("t", frame)
    assert [tuple(r) for r in e.sql("SELECT i, p FROM t WHERE i > 45").collect()] == [(50, "")]


def test_chunk_reader_skips_chunks(tmp_path):
    from pyspark.sql.datasource import GreaterThan

    path = str(tmp_path / "t.cef")
    chunk_file.write_chunks(path, [("x", chunk_file.INT64, list(range(10)))], 4)
    reader = chunk_file.ChunkReader(path)
    assert len(list(reader.pushFilters([GreaterThan(("x",), 7)]))) == 1
    assert [p.k for p in reader.partitions()] == [2]


@pytest.mark.parametrize("raw", [b"", bytes(16), struct.pack("<II", 1000, chunk_file.MAGIC), b"\x02\x01\0\0\0\0" + struct.pack("<II", 6, chunk_file.MAGIC)])
def test_bad_chunk_files(tmp_path, raw):
    (tmp_path / "x").write_bytes(raw)
    with pytest.raises(chunk_file.FormatError):
        chunk_file.read_footer(str(tmp_path / "x"))


def test_wire_round_trip():
    result = wire.ResultSet(["a", "é"], [Kind.INT64, Kind.TEXT], [(1, "x"), (None, None), (-5, "")])
    assert wire.decode_result(wire.encode_result(result)) == result
    other = wire.ResultSet(["d", "b"], [Kind.DOUBLE, Kind.BOOL], [(1.5, True), (None, False)])
    assert wire.decode_result(wire.encode_result(other)) == other
    with pytest.raises(wire.WireError):
        wire.decode_result(wire.encode_result(result)[:-1])


@pytest.mark.parametrize("raw", [b"\1\0", struct.pack("<I", 0xFFFFFFFF), struct.pack("<I", 1), struct.pack("<IBB", 2, 9, 1), struct.pack("<IB", 5, 1)])
def test_bad_frames(raw):
    import io

    with pytest.raises(wire.WireError):
        wire.read_frame(io.BytesIO(raw).read)


def test_service_and_client(spark, capsys):
    import sys

    from corvane.server.cli import Client, run, shown
    from corvane.server.service import Service

    e = Engine(spark).register("t", spark.createDataFrame([(1, 2.5, True, "x"), (2, None, None, None)], "a int, d double, b boolean, s string"))
    with Service(("127.0.0.1", 0), e, workers=2) as service:
        threading.Thread(target=service.serve_forever, daemon=True).start()
        client = Client(*service.server_address)
        got = client.query("SELECT a, d, b, s FROM t ORDER BY a")
        assert shown(got) == "a | d | b | s\n1 | 2.5000 | true | x\n2 | NULL | NULL | NULL\n(2 rows)"
        assert client.query("SELECT a FROM t WHERE a > 9").names == ["a"]
        assert client.query("SELECT nope FROM t") == "1:8: column nope is unknown"
        run(client, "SELECT COUNT(*) AS n FROM t", sys.stdout, sys.stderr)
        run(client, "SELECT", sys.stdout, sys.stderr)
        said = capsys.readouterr()
        assert said.out == "n\n2\n(1 row)\n" and said.err.startswith("ERROR: 1:7:")
        assert "OVERFLOW" in client.query("SELECT a + 9223372036854775807 AS x FROM t")
        client.close()
        service.shutdown()


def test_service_answers_more_connections_than_workers(spark):
    from corvane.server.cli import Client
    from corvane.server.service import Service

    e = Engine(spark).register("t", spark.range(10))
    with Service(("127.0.0.1", 0), e, workers=2) as service:
        threading.Thread(target=service.serve_forever, daemon=True).start()
        got = []

        def ask():
            client = Client(*service.server_address)
            got.append(client.query("SELECT COUNT(*) AS n FROM t").rows)
            client.close()

        threads = [threading.Thread(target=ask) for _ in range(6)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert got == [[(10,)]] * 6
        idle = Client(*service.server_address)
        service.shutdown()
    idle.close()


def test_chunk_files_written_by_spark(spark, tmp_path):
    chunk_file.register(spark)
    rows = [(i, float(i) if i % 7 else None, i % 2 == 0, f"t{i % 5}" if i % 11 else None) for i in range(5000)]
    frame = spark.createDataFrame(rows, "i long, d double, b boolean, s string").repartitionByRange(3, "i")
    path = str(tmp_path / "t")
    frame.write.format("corvane_chunks").mode("append").option("encoding", "runs").save(path)
    back = spark.read.format("corvane_chunks").load(path)
    assert sorted(tuple(r) for r in back.collect()) == rows
    few = spark.read.format("corvane_chunks").option("columns", "s, i").load(path)
    assert few.columns == ["s", "i"] and few.where("i >= 4990").count() == 10
    frame.limit(3).write.format("corvane_chunks").mode("overwrite").save(path)
    assert spark.read.format("corvane_chunks").load(path).count() == 3
    with pytest.raises(Exception, match="can't be stored"):
        spark.sql("select array(1) as a").write.format("corvane_chunks").mode("append").save(str(tmp_path / "u"))
