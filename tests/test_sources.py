"""Formats and tables: round trips, damaged input, time travel, concurrent writers, late rows."""

import io
import struct
import uuid

import pytest

from lodestar.sources import avro, catalogs, files, protobuf, roaring
from lodestar.sources.delta import ConcurrentWrite, DeltaTable, z85_decode, z85_encode
from lodestar.sources.iceberg import IcebergTable, bucket_of, from_single_value, murmur3, single_value
from lodestar.streaming import pipeline
from pyspark.sql import functions as F
from pyspark.sql import types as T


def test_csv_tenths_and_bad_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Hamburg;12.3\nBulawayo;-8.9\nX;\n")
    got = files.read_csv(spark, str(tmp_path / "a.csv"), "name string, t int", ";", tenths=("t",))
    assert {tuple(r) for r in got.collect()} == {("Hamburg", 123), ("Bulawayo", -89), ("X", None)}
    (tmp_path / "b.csv").write_text("a;nope\n")
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "b.csv"), "name string, t int", ";", tenths=("t",)).collect()
    assert files.read_csv(spark, str(tmp_path / "b.csv"), "name string, t int", ";", tenths=("t",), strict=False).first()["t"] is None


def test_ndjson_errors(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1}\r\n\nbroken\n{"k": 2}\n')
    at = str(tmp_path / "a.json")
    assert sorted(r["k"] for r in files.read_ndjson(spark, at, "k int", ignore_errors=True).collect()) == [1, 2]
    assert files.skipped_lines(spark, at, "k int").first()["n"] == 1
    with pytest.raises(Exception):
        files.read_ndjson(spark, at, "k int").collect()


SCHEMA = {"type": "record", "name": "r", "fields": [
    {"name": "a", "type": ["null", "int"]}, {"name": "b", "type": "string"}, {"name": "e", "type": {"type": "enum", "name": "e", "symbols": ["X", "Y"]}}, {"name": "f", "type": {"type": "fixed", "name": "f", "size": 2}},
    {"name": "m", "type": {"type": "map", "values": "double"}}, {"name": "l", "type": {"type": "array", "items": {"type": "record", "name": "i", "fields": [{"name": "z", "type": "long"}]}}}, {"name": "t", "type": "boolean"}]}
ROWS = [{"a": None, "b": "é", "e": "Y", "f": b"ab", "m": {"k": 1.5}, "l": [{"z": -(2**62)}], "t": True}, {"a": -7, "b": "", "e": "X", "f": b"\0\1", "m": {}, "l": [], "t": False}]


@pytest.mark.parametrize("codec", ["null", "deflate", "snappy", "zstandard"])
def test_avro_containers(codec):
    raw = avro.write_container(SCHEMA, ROWS * 30, codec, block_rows=7)
    schema, rows = avro.read_container(raw)
    assert schema == SCHEMA and list(rows) == ROWS * 30
    for cut in (3, 40, len(raw) - 5):
        with pytest.raises(Exception):
            list(avro.read_container(raw[:cut])[1])


def test_avro_datum_and_numbers():
    for n in (0, -1, 1, 63, -64, 64, 2**31, -(2**63), 2**63 - 1):
        assert avro.read_long(io.BytesIO(avro.write_long(n))) == n
    assert avro.decode(SCHEMA, io.BytesIO(avro.encode(SCHEMA, ROWS[0]))) == ROWS[0]


def test_protobuf():
    p = protobuf.put
    d = [(1, "a", 5, False), (2, "b", 9, False), (3, "c", 17, True), (4, "d", 1, False), (5, "n", 11, False), (6, "f", 7, True)]
    raw = p(1, 0, -3) + p(2, 2, "é".encode()) + p(3, 0, 5) + p(3, 2, protobuf.put_varint(2)) + p(4, 1, struct.pack("<d", 1.5)) + p(5, 2, b"xy") + p(6, 2, struct.pack("<II", 1, 2)) + p(9, 0, 1)
    assert protobuf.decode(raw, d) == {"a": -3, "b": "é", "c": [-3, 1], "d": 1.5, "n": b"xy", "f": [1, 2]}
    assert protobuf.decode(b"", d)["a"] is None
    assert protobuf.confluent(b"\0" + struct.pack(">I", 9) + b"\x04\x02\x04" + b"body") == (9, [1, 2], b"body")
    for bad in (raw[:-1], b"\x0b", b"\xff" * 12):
        with pytest.raises(ValueError):
            protobuf.decode(bad, d)


def test_roaring():
    values = [1, 5, 70_000, 2**31, *range(200_000, 210_000)]
    assert roaring.read32(roaring.write32(values))[0].tolist() == sorted(values)
    wide = [3, 2**33 + 1, 2**33 + 70_000]
    back = roaring.read64(roaring.write64(wide))
    assert back.tolist() == wide and roaring.contains(back, 2**33 + 1) and not roaring.contains(back, 4)
    runs = struct.pack("<I", 12347) + b"\x01" + struct.pack("<HH", 2, 9) + struct.pack("<HHH", 1, 10, 9)
    assert roaring.read32(runs)[0].tolist() == [(2 << 16) + i for i in range(10, 20)]
    assert z85_decode(z85_encode(b"12345678")) == b"12345678"


def table(spark, tmp_path, rows=((1, "a"), (2, "b"), (3, "c"))):
    t = DeltaTable(spark, str(tmp_path / uuid.uuid4().hex))
    t.create(T.StructType([T.StructField("id", T.LongType()), T.StructField("s", T.StringType())]))
    t.append(spark.createDataFrame(rows, "id bigint, s string"))
    return t


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_delta_commits(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(spark.createDataFrame([(9, "z"), (10, None)], "id bigint, s string"))
    assert ids(t.read()) == [1, 2, 3, 9, 10] and ids(t.read(version=1)) == [1, 2, 3] and ids(t.read(version=0)) == []
    with pytest.raises(ConcurrentWrite):  # a writer that started from an older version
        t.append(spark.createDataFrame([(11, "x")], "id bigint, s string"), base=1)
    with pytest.raises(ValueError):
        t.read(timestamp_ms=5)
    with pytest.raises(FileNotFoundError):
        t.read(version=77)
    assert ids(t.read(conditions=[("id", ">", 8)])) == [9, 10]  # as numbers, not as text
    assert len(t.pruned(t.snapshot(), [("id", ">", 8)])) < len(t.snapshot().files)


def test_delta_changes(spark, tmp_path):
    t = table(spark, tmp_path)
    t.update(F.col("id") == 2, {"s": F.lit("B")})
    t.delete(F.col("s").isNull() | (F.col("id") == 3))
    t.merge(spark.createDataFrame([(2, "gone"), (5, "new"), (1, "A")], "id bigint, s string"), "id", delete=F.col("s") == "gone")
    assert sorted(tuple(r) for r in t.read().collect()) == [(1, "A"), (5, "new")]
    v = t.restore(1)
    assert sorted(tuple(r) for r in t.read().collect()) == [(1, "a"), (2, "b"), (3, "c")]
    t.delete_by_vector(F.col("id") == 1)
    t.delete_by_vector(F.col("id") == 3)
    assert ids(t.read()) == [2] and ids(t.read(version=v)) == [1, 2, 3]
    t.optimize()
    assert t.vacuum(0, dry_run=True) and ids(t.read()) == [2]
    t.vacuum(0)
    assert ids(t.read()) == [2]


def test_delta_merge_of_rows_that_match_none(spark, tmp_path):
    """Rows that are new whatever their key stand beside the old ones of that key, and beside the source's own."""
    t = table(spark, tmp_path)
    source = spark.createDataFrame([(1, "A", False), (2, "x", True), (1, "y", True), (9, "z", True), (3, "w", None)], "id bigint, s string, new boolean")
    t.merge(source, "id", match=~F.col("new"))
    assert sorted(tuple(r) for r in t.read().collect()) == [(1, "A"), (1, "y"), (2, "b"), (2, "x"), (3, "c"), (3, "w"), (9, "z")]


def test_delta_merge_beyond_a_million_keys(spark, tmp_path):
    """The query's new keys, a million on, are those of other orders."""
    import datetime

    from lodestar import catalog, plans  # noqa: F401

    day = datetime.datetime(2020, 1, 2)
    rows = [(k + i * 1_000_000, k, status, 5.0, day) for i in range(3) for k, status in ((1, "P"), (2, "O"), (3, "P" if i else "F"), (4, "F" if i else "P"))]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    changed = [(k + n, cust, "X", 1.0, day.date()) for k, cust, status, *_ in rows if status == "P" for n in (0, 1_000_000)]
    got = catalog.QUERIES["delta_merge"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == sorted([(k, cust, status, price, day.date()) for k, cust, status, price, _ in rows if status != "P"] + changed)


def test_iceberg(spark, tmp_path):
    t = IcebergTable(spark, str(tmp_path / "t"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("sym", T.StringType()), T.StructField("price", T.DoubleType()), T.StructField("active", T.BooleanType())])
    t.create(schema, {"sym": "identity"})
    ddl = "id bigint, sym string, price double, active boolean"
    t.append(spark.createDataFrame([(1, "A", 1.0, True), (2, "B", 2.0, False), (5, "A", 3.0, None)], ddl))
    t.append(spark.createDataFrame([(6, "C", None, True)], ddl))
    assert ids(t.read()) == [1, 2, 5, 6]
    first = t.metadata()["snapshots"][0]
    assert ids(t.read(snapshot_id=first["snapshot-id"])) == ids(t.read(timestamp_ms=first["timestamp-ms"])) == [1, 2, 5]
    with pytest.raises(ValueError):
        t.read(snapshot_id=42)
    assert ids(t.read(timestamp_ms=1)) == []
    assert ids(t.read(conditions=[("sym", "=", "A")])) == [1, 5]
    t.rollback(first["snapshot-id"])
    assert ids(t.read()) == [1, 2, 5]
    t.delete_rows(F.col("id") == 5)
    t.delete(F.col("id") == 1)
    assert ids(t.read()) == [2]


def test_iceberg_values():
    assert murmur3(b"iceberg") == 1210000089 and murmur3(struct.pack("<q", 34)) == 2017239379
    assert bucket_of(34, 16) == 2017239379 % 16 and bucket_of(None, 16) is None
    for kind, v in (("long", -5), ("int", 7), ("double", 1.5), ("string", "é"), ("boolean", True)):
        assert from_single_value(kind, single_value(kind, v)) == v


def test_catalog(spark, tmp_path):
    cat = catalogs.FilesystemCatalog(spark, str(tmp_path / "c"))
    cat.create_namespace("n")
    t = DeltaTable(spark, cat.location("n", "d"))
    t.create(T.StructType([T.StructField("id", T.LongType())]))
    assert cat.namespaces() == ["n"] and cat.tables("n") == ["d"] and cat.kind("n", "d") == "delta" and cat.open("n", "d").snapshot().version == 0
    cat.drop("n", "d")
    assert cat.tables("n") == []
    with pytest.raises(FileNotFoundError):
        cat.open("n", "d")
    with pytest.raises(ValueError):
        catalogs.remote_settings("x", "nosuch")


def stream_of(spark, tmp_path, batches):
    at = tmp_path / "in"
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "k bigint, t string, v double").select("k", F.to_timestamp("t").alias("ts"), "v").coalesce(1)
        df.write.mode("append").parquet(str(at))
    return pipeline.source(spark, str(at), "k bigint, ts timestamp, v double")


def test_state_lives_between_batches(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:00:0{i}", float(i * i)) for i in range(6)]
    out = str(tmp_path / "out")
    made = pipeline.ema_by_key(stream_of(spark, tmp_path, [rows[:2], rows[2:5], rows[5:]]), "k", ["ts"], "v", 0.5, carry=["v"])
    pipeline.Pipeline(made).run(str(tmp_path / "s"), sink=lambda b, n: b.write.mode("append").parquet(out))
    want, y = [], None
    for _, _, v in rows:
        y = v if y is None else 0.5 * v + 0.5 * y
        want.append(y)
    assert sorted(r["ema"] for r in spark.read.parquet(out).collect()) == sorted(want)


def test_late_rows_are_dropped(spark, tmp_path):
    batches = [[(1, "2024-01-01 00:00:00", 1.0)], [(1, "2024-01-01 05:00:00", 1.0)], [(1, "2024-01-01 05:30:00", 1.0)], [(1, "2024-01-01 00:10:00", 5.0)], [(1, "2024-01-01 09:00:00", 1.0)]]
    made = pipeline.windowed(stream_of(spark, tmp_path, batches), "ts", "1 hour", "1 hour", None, [], F.sum("v").alias("s"))
    pipeline.Pipeline(made).run(str(tmp_path / "s"), table="late_rows", mode="append")
    got = {str(r["window"]["start"]): r["s"] for r in spark.table("late_rows").collect()}
    assert got["2024-01-01 00:00:00"] == 1.0


def test_sessions(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:04:00"), (1, "2024-01-01 01:00:00")], "k int, t string").select("k", F.to_timestamp("t").alias("ts"))
    assert sorted(r["n"] for r in pipeline.sessions(df, "ts", "1 hour", "5 minutes", ["k"], F.count("*").alias("n")).collect()) == [1, 2]


def test_iceberg_manifests_follow_the_format(spark, tmp_path):
    from lodestar.sources import avro as A

    t = IcebergTable(spark, str(tmp_path / "t"))
    t.create(T.StructType([T.StructField("id", T.LongType()), T.StructField("day", T.DateType())]), {"day": "identity", "id": "bucket[4]"})
    df = spark.sql("SELECT 7L AS id, DATE'1969-12-31' AS day UNION ALL SELECT NULL, DATE'2024-02-29'")
    t.append(df)
    meta = t.metadata()
    snap = meta["snapshots"][-1]
    schema, listed = A.read_container(t.store.read(t._local(meta, snap["manifest-list"])))
    assert {f["name"]: f["field-id"] for f in schema["fields"]}["manifest_path"] == 500
    entry = next(iter(listed))
    assert (entry["sequence_number"], entry["added_files_count"], entry["added_rows_count"], entry["content"]) == (1, 2, 2, 0)
    schema, rows = A.read_container(t.store.read(t._local(meta, entry["manifest_path"])))
    files = [r["data_file"] for r in rows]
    assert sorted((f["partition"]["day"], f["partition"]["id_bucket"]) for f in files if f["partition"]["id_bucket"] is not None) == [(-1, bucket_of(7, 4))]
    assert all(isinstance(f["lower_bounds"], list) and f["record_count"] == 1 for f in files)
    t.rename_column("id", "key")
    assert sorted((r["key"] or 0) for r in t.read().collect()) == [0, 7]
    import pyarrow.parquet as pq

    path = next((tmp_path / "t" / "data").rglob("*.parquet"))
    assert {f.name: f.metadata[b"PARQUET:field_id"] for f in pq.read_schema(path)} == {"id": b"1", "day": b"2"}


def test_delta_of_another_writer(spark, tmp_path):
    """Files at the root and in folders of values, typed statistics, encoded paths."""
    import json

    import pyarrow as pa
    import pyarrow.parquet as pq

    root = tmp_path / "other table"
    (root / "_delta_log").mkdir(parents=True)
    (root / "p=a%20+b").mkdir()
    pq.write_table(pa.table({"id": pa.array([1, 12], pa.int64())}), root / "part-0.parquet")
    pq.write_table(pa.table({"id": pa.array([3, None], pa.int64())}), root / "p=a%20+b" / "part-1.parquet")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("p", T.StringType())])
    meta = {"id": "x", "format": {"provider": "parquet", "options": {}}, "schemaString": schema.json(), "partitionColumns": ["p"], "configuration": {}}
    adds = [
        {"path": "part-0.parquet", "partitionValues": {"p": None}, "size": 1, "modificationTime": 1, "dataChange": True, "stats": json.dumps({"numRecords": 2, "minValues": {"id": 1}, "maxValues": {"id": 12}, "nullCount": {"id": 0}})},
        {"path": "p=a%2520+b/part-1.parquet", "partitionValues": {"p": "a +b"}, "size": 1, "modificationTime": 1, "dataChange": True},
    ]
    lines = [{"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}, {"metaData": meta}, *({"add": a} for a in adds)]
    (root / "_delta_log" / f"{0:020d}.json").write_text("\n".join(map(json.dumps, lines)))
    t = DeltaTable(spark, str(root))
    assert sorted((r["id"] or 0, r["p"]) for r in t.read().collect()) == [(0, "a +b"), (1, None), (3, "a +b"), (12, None)]
    assert ids(t.read(conditions=[("id", ">", 11)])) == [12]
    t.delete_by_vector(F.col("id") == 3)
    t.update(F.col("id") == 1, {"p": F.lit("x y/ü")})
    assert sorted((r["id"] or 0, r["p"]) for r in t.read().collect()) == [(0, "a +b"), (1, "x y/ü"), (12, None)]
    stats = [json.loads(a["stats"]) for a in t.snapshot().files.values() if "data-" in a["path"]]
    assert all(isinstance(x["minValues"]["id"], int) for x in stats)
    t.vacuum(0)
    assert sorted(r["id"] or 0 for r in t.read().collect()) == [0, 1, 12]


def test_parquet_round_trip_is_of_the_whole_table(spark):
    from lodestar.plans import formats

    d = "/root/testdata/sf0.001"
    made, want = formats.parquet_round_trip_all(spark, d), formats.orders(spark, d)
    assert made.columns == want.columns
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("parts", [1, 3])
def test_delta_opens_checkpoints_of_the_format(spark, tmp_path, parts):
    """A checkpoint made by hand, in one file or several, and no commits before it."""
    import pyarrow.parquet as pq

    df = spark.createDataFrame([(i, None if i % 3 == 0 else f"p{i % 3}") for i in range(30)], "id bigint, part string")
    t = DeltaTable(spark, str(tmp_path / "t"))
    t.create(df.schema, ("part",))
    t.append(df.filter("id < 20"))
    t.append(df.filter("id >= 20"))
    log = tmp_path / "t" / "_delta_log"
    version = t.checkpoint()
    made = log / f"{version:020d}.checkpoint.parquet"
    rows = pq.read_table(made)  # one file, a struct column each kind of action
    assert {"protocol", "metaData", "add", "remove", "txn"} <= set(rows.schema.names)
    assert rows["add"].combine_chunks().is_valid().to_pylist().count(True) >= 4
    if parts > 1:
        made.unlink()
        for k in range(parts):
            pq.write_table(rows.take(list(range(k, rows.num_rows, parts))), log / f"{version:020d}.checkpoint.{k + 1:010d}.{parts:010d}.parquet")
        pq.write_table(rows.slice(0, 1), log / f"{version + 5:020d}.checkpoint.{1:010d}.{2:010d}.parquet")  # incomplete, so none
    for commit in log.glob("*.json"):
        commit.unlink()
    for crc in log.glob(".*.crc"):
        crc.unlink()
    again = DeltaTable(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, again.read().select("id", "part").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert again.append(df.limit(1)) == version + 1 and again.read().count() == 31
