"""Sources, sinks and the stream."""

import gzip
import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from statloom.operators import relational as R
from statloom.sources import files
from statloom.streaming.issues import period_sums


def test_csv_keeps_zeros(spark, tmp_path):
    path = f"{tmp_path}/games"
    spark.createDataFrame([("0022300001", 1.5), ("0022300002", None)], "id string, x double").coalesce(1).write.csv(path, header=True)
    got = files.text_ids_csv(spark, path, "id string, x double").orderBy("id").collect()
    assert [(r.id, r.x) for r in got] == [("0022300001", 1.5), ("0022300002", None)]


@pytest.fixture
def payloads(tmp_path):
    sums = {}
    for game in ("a", "b"):
        raw = json.dumps({"data": [{"actionNumber": k, "subType": None if k else game} for k in range(3)]}).encode()
        (tmp_path / f"{game}.json").write_bytes(raw)
        sums[f"{game}.json"] = hashlib.sha256(raw).hexdigest()
        with gzip.open(tmp_path / f"{game}.json.gz", "wb") as f:
            f.write(raw)
    return tmp_path, sums


ROW = "actionNumber: bigint, subType: string"


def test_payloads(spark, payloads):
    folder, sums = payloads
    got = files.payload_rows(spark, f"{folder}/*.gz", ROW).orderBy("file", "ingest_ord").collect()
    assert [(r.file[-9:], r.ingest_ord, r.actionNumber, r.subType) for r in got[:2]] == [("a.json.gz", 0, 0, "a"), ("a.json.gz", 1, 1, None)] and len(got) == 6
    assert files.sealed_rows(spark, f"{folder}/*.json", ROW, sums).count() == 6
    assert files.hashes_by_name(spark, f"{folder}/*.json") == sums
    (folder / "b.json").write_bytes(b'{"data": []}')
    for expected in (sums, {"a.json": sums["a.json"]}):
        with pytest.raises(PySparkException, match="changed or unknown file"):
            files.sealed_rows(spark, f"{folder}/*.json", ROW, expected).collect()


def test_discovery(spark, payloads, tmp_path):
    folder, _ = payloads
    assert files.exactly_one(spark, f"{folder}/a.json").endswith("/a.json") and len(files.found(spark, f"{folder}/*.json")) == 2
    assert files.newest(spark, f"{folder}/*.gz").endswith(".gz") and files.json_document(spark, f"{folder}/a.json")["data"][0]["subType"] == "a"
    for call, pattern in ((files.exactly_one, "*.json"), (files.exactly_one, "z*"), (files.newest, "z*")):
        with pytest.raises(FileNotFoundError):
            call(spark, f"{folder}/{pattern}")
    seasons = f"{tmp_path}/seasons"
    spark.createDataFrame([(1, "2022-23"), (2, "2023-24")], "x int, season string").write.partitionBy("season").parquet(seasons)
    assert [r.x for r in files.season_table(spark, seasons, "2023-24").collect()] == [2]
    with pytest.raises(FileNotFoundError):
        files.season_table(spark, seasons, "2024-25")
    assert [tuple(r) for r in files.with_status(spark, {"a": seasons, "b": f"{tmp_path}/none"}).orderBy("name").collect()] == [("a", "PRESENT", 2), ("b", "SOURCE_MISSING", None)]
    assert files.over_parquet(spark, "select count(*) as n from {source} where x > :least", seasons, least=1).first().n == 1


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, v double")
    inputs, parameters = {"x": "hash"}, {"penalty": 2500}
    run = files.write_run({"t": table, "u": table.select("k")}, str(tmp_path / "runs"), inputs, parameters)
    manifest = files.verify_run(spark, run)
    assert files.write_run({"t": table}, str(tmp_path / "runs"), inputs, parameters) == run and manifest["run_id"] == files.run_id(inputs, parameters) != files.run_id(inputs, {"penalty": 1})
    assert spark.read.parquet(f"{run}/t.parquet").count() == 2
    part = next((tmp_path / "runs").glob("*/t.parquet/*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    (part.parent / f".{part.name}.crc").unlink()  # the store's own checksum would find it first
    with pytest.raises(OSError, match="changed"):
        files.write_run({"t": table}, str(tmp_path / "runs"), inputs, parameters)
    next((tmp_path / "runs").glob("*/manifest.json")).unlink()
    with pytest.raises(OSError, match="whole"):
        files.verify_run(spark, run)
    files.write_whole(table, f"{tmp_path}/v1")
    files.merge_back(spark, f"{tmp_path}/v1", spark.createDataFrame([(2, 9.0, "n")], "k int, v double, w string"), ["k"])
    assert [(r.k, r.s, r.v, r.w) for r in files.read_whole(spark, f"{tmp_path}/v1").orderBy("k").collect()] == [(1, "a", 1.0, None), (2, "b", 9.0, "n")]
    files.put_text(spark, f"{tmp_path}/note.json", '{"a": 2}')
    with pytest.raises(FileExistsError):
        files.put_text(spark, f"{tmp_path}/note.json", '{"a": 3}')
    files.copy_whole(spark, f"{tmp_path}/note.json", f"{tmp_path}/copy.json")
    assert files.json_document(spark, f"{tmp_path}/copy.json") == {"a": 2}


@pytest.mark.parametrize("step", ["rows", "pointer", "name"])
def test_a_write_that_fails_between_steps(spark, tmp_path, step):
    """The old table stays, for new readers and for one that has it open; the next write succeeds."""
    path, values = f"{tmp_path}/t", lambda: sorted(r.id for r in files.read_whole(spark, f"{tmp_path}/t").collect())
    with pytest.raises(FileNotFoundError):
        files.read_whole(spark, path)
    files.write_whole(spark.range(3), path)
    held = files.read_whole(spark, path)

    def fail(now: str) -> None:
        if now == step:
            raise RuntimeError(now)

    with pytest.raises(RuntimeError, match=step):
        files.write_whole(spark.range(10, 12), path, before=fail)
    assert values() == [0, 1, 2]
    files.write_whole(spark.range(20, 23), path)
    assert values() == [20, 21, 22] and sorted(r.id for r in held.collect()) == [0, 1, 2]
    assert files.drop_versions(spark, path, keep=1) >= 1 and values() == [20, 21, 22]


def test_writers_that_meet(spark, tmp_path):
    """Two writers get two numbers; one that has read an older version is refused."""
    path = f"{tmp_path}/t"
    files.write_whole(spark.range(2), path)
    seen = max(n for n, _ in files.pointers(spark, path))

    def other(now: str) -> None:
        if now == "pointer":
            files.write_whole(spark.range(5), path)

    with pytest.raises(OSError, match="meanwhile"):
        files.write_whole(spark.range(7), path, before=other, after=seen)
    assert files.read_whole(spark, path).count() == 5
    files.write_whole(spark.range(7), path, before=other)
    assert files.read_whole(spark, path).count() == 7 and len(files.pointers(spark, path)) == 4


def test_keys_and_as_of(spark):
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert R.unique_right(right.where("k = 2"), ["k"]).count() == 1
    with pytest.raises(ValueError, match="1"):
        R.unique_right(right, ["k"])
    left = spark.sql("select id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(id as int) * 5) as ts from range(40)")
    dates = spark.sql("select timestamp'2024-01-01 07:00:00' + make_interval(0, 0, 0, 0, cast(id as int) * 9) as d from range(12)")
    few, many = (R.asof_broadcast(left, dates, "ts", "d", most).select("id", "d").orderBy("id").collect() for most in (5000, 3))
    times = sorted(r.d for r in dates.collect())
    want = [(r.id, max((x for x in times if x < r.ts), default=None)) for r in left.orderBy("id").collect()]
    assert [tuple(r) for r in few] == want == [tuple(r) for r in many]


def test_spans_in_buckets(spark):
    points = spark.range(0, 200).selectExpr("id % 3 as k", "cast(id as double) as t")
    spans = spark.createDataFrame([(0, 0.0, 300.0), (0, 5.0, 6.0), (1, 4.0, 4.0), (1, 10.0, 40.0), (2, 50.0, 50.5), (None, 0.0, 9.0)], "k long, a double, b double")
    want = sorted((p.k, p.t, s.a) for p in points.collect() for s in spans.collect() if p.k == s.k and s.a <= p.t < s.b)
    assert sorted((r.k, r.t, r.a) for r in R.within(points, spans, ["k"], "t", "a", "b").collect()) == want


def test_quantiles_and_places(spark):
    rows = [(k, float(v)) for k in (None, 1, 2) for v in range(1, 4 + (k or 0) * 3)] + [(1, None), (2, 5.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    want = {r.k: list(r.q) for r in df.where("v is not null").groupBy("k").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q")).collect()}
    got = {r.k: r.q for r in R.quantiles(df, ["k"], "v", [0.1, 0.5, 0.9]).collect()}
    assert {k: [round(x, 9) for x in q] for k, q in got.items()} == {k: [round(x, 9) for x in q] for k, q in want.items()}
    assert R.placed(df.limit(0), ["k"], ["v"]).count() == 0
    for r in R.placed(df, ["k"], ["v"]).collect():
        own = sorted((v for k, v in rows if k == r.k), key=lambda v: (v is not None, v or 0))
        assert own[r._place] == r.v and r._n == len(own)


def test_stream_and_table_agree(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("cast(ts as timestamp) as ts", "value")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = period_sums(stream, "ts", "value", late="60 days").writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    query.awaitTermination(120)
    rounded = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in df.collect())
    assert rounded(spark.table("sums")) == rounded(period_sums(events, "ts", "value")) != []
