import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from vecloom import ConfigManager, Dataset, DatasetDict, Field, Kind, Schema, StorageConfig, StorageType, configure_logger, list_datasets, load_dataset
from vecloom.operators.validate import InvalidRows
from vecloom.plans import harness
from vecloom.sources import dataset as module
from vecloom.sources import storage
from vecloom.sources.export import FolderSink, MemorySink
from vecloom.streaming import ingest

SCHEMA = Schema((Field("id", Kind.INT64, is_primary=True), Field("vector", Kind.FLOAT_VECTOR, dim=4), Field("text", Kind.VARCHAR, max_length=20)))


def data(n, start=0):
    rng = np.random.default_rng(start)
    return pd.DataFrame({"id": range(start, start + n), "vector": [rng.random(4) for _ in range(n)], "text": [f"text_{k}" for k in range(n)]})


@pytest.fixture
def store(spark, tmp_path):
    ConfigManager().init_storage(str(tmp_path / "root"), spark=spark)
    return tmp_path


def test_end_to_end(store):
    d = load_dataset("one", schema=SCHEMA)
    assert isinstance(d, DatasetDict) and set(d) == {"train", "test", "neighbors"}
    d["train"].write(data(50))
    d["test"].write(data(10), mode="overwrite")
    assert len(d["train"].read("full")) == 50 and d["train"].get_total_rows("test") == 10
    assert [len(x) for x in d["train"].read("batch", batch_size=20)] == [20, 20, 10]
    assert {len(x) for x in d["test"].read("stream")} == {1}
    truth = d.compute_neighbors("vector", top_k=3)
    assert truth.count() == 10 and d.get_neighbors().count() == 10
    assert {r.id: r.neighbors_id[0] for r in d.get_neighbors().collect()} == {k: k for k in range(10)}
    some = d.compute_neighbors("vector", top_k=3, query_expr="id >= 40", metric_type="l2")
    assert min(min(r.neighbors_id) for r in some.collect()) >= 40
    with pytest.raises(ValueError):
        d["neighbors"].frame()
    assert d["neighbors"].summary()["num_rows"] > 0
    assert d.get_neighbors().first() != d.get_neighbors("id >= 40", "l2").first()
    with pytest.raises(FileNotFoundError):
        d.get_neighbors("id > 1")
    s = d.summary()["train"]
    assert (s["num_rows"], s["num_columns"], s["storage_type"]) == (50, 3, "local") and s["size"] > 0 and s["size_text"].endswith(" MB")
    assert "num_rows" in repr(d) and d["train"].get_features()["vector"] == "array<float>"
    assert {r.split: r.num_rows for r in d.summary_frame().collect()}["test"] == 10


def test_catalog_and_sidecars(store):
    load_dataset("a", schema=SCHEMA)["train"].set_metadata({"k": 1})
    load_dataset("b", "train", SCHEMA)
    assert list_datasets() == [{"name": "a", "metadata": {"k": 1}}, {"name": "b", "metadata": {}}]
    assert load_dataset("a", ["train"])["train"].get_schema() == SCHEMA
    assert Dataset("none").get_schema() is None and Dataset("none").get_metadata() == {}
    with pytest.raises(ValueError):
        Dataset("../x")


def test_all_inputs(store):
    d = load_dataset("inputs", "train", SCHEMA)
    one = {"id": 1, "vector": [1.0, 2.0, 3.0, 4.0], "text": "a"}
    d.write([one])
    d.write({k: [v] for k, v in one.items()})
    d.write(pd.DataFrame([one]))
    d.write(pa.Table.from_pylist([one]))
    d.write(d.spark.createDataFrame([one], SCHEMA.struct()))
    assert d.get_num_rows() == 5 and d.frame().schema["vector"].dataType.simpleString() == "array<float>"
    with pytest.raises(TypeError):
        d.get_writer().frame(5, SCHEMA)
    d.write([{**one, "more": "x"}])
    assert d.get_num_rows() == 6


def test_failed_writes_lose_nothing(store):
    d = load_dataset("safe", "train", SCHEMA)
    d.write(data(5))
    for bad in ([{"id": 9, "vector": [1.0], "text": "a"}], [{"id": 9, "vector": [1.0] * 4, "text": "x" * 21}], [{"id": 9, "text": "a"}]):
        with pytest.raises(InvalidRows):
            d.write(bad, mode="overwrite")
    assert d.get_num_rows() == 5
    d.write(data(3, 100), mode="overwrite")
    assert sorted(r.id for r in d.frame().collect()) == [100, 101, 102]
    with pytest.raises(ValueError):
        Dataset("safe", "neighbors").write(data(1))
    with pytest.raises(ValueError):
        Dataset("unknown").write(data(1))
    with pytest.raises(ValueError):
        d.write(data(1), mode="merge")
    Dataset("safe", "test").write([{"id": 9, "vector": [1.0], "text": "a"}])  # test isn't checked


def test_file_sizes(store, monkeypatch):
    monkeypatch.setattr(module, "estimate_rows_per_file", lambda *_: 10_000)
    schema = Schema((Field("id", Kind.INT64, is_primary=True),))
    d = load_dataset("many", "train", schema)
    d.write(d.spark.range(25_000).coalesce(1))
    assert d.get_num_files() == 3 and d.get_num_rows() == 25_000 and d.frame().distinct().count() == 25_000
    with d.get_writer() as w:
        w.write(d.spark.range(5))
    assert d.get_num_rows() == 25_005


def test_estimate(store):
    d = load_dataset("est", "train", SCHEMA)
    n = module.estimate_rows_per_file(d.spark.range(1000), d.files, d.root, 1)
    assert n >= 10_000 and n % 10_000 == 0
    assert module.estimate_rows_per_file(d.spark.range(0), d.files, d.root, 1) == 10_000


def test_reading_edges(store):
    d = load_dataset("empty", "train", SCHEMA)
    assert d.read("full").empty and list(d.read("stream")) == [] and d.summary()["num_rows"] == 0
    assert d.frame().columns == ["id", "vector", "text"]
    for bad in (dict(mode="all"), dict(mode="batch", batch_size=0), dict(mode="batch", batch_size=None)):
        with pytest.raises(ValueError):
            d.read(**bad)
    d.write(data(7))
    d.write(data(5, 7))
    assert [len(x) for x in d.read("batch", batch_size=4)] == [4, 4, 4]
    assert [len(x) for x in d.read("batch", batch_size=5)] == [5, 5, 2]


def test_copy(store, spark):
    d = load_dataset("copied", schema=SCHEMA)
    d["train"].write(data(5))
    goal = StorageConfig(StorageType.LOCAL, str(store / "goal"))
    report = d.save(goal).collect()
    assert {r.status for r in report} == {"copied"} and any(r.destination.endswith("schema.json") for r in report)
    assert Dataset("copied", config=goal, spark=spark).get_num_rows() == 5
    left = storage.copy(spark, d["train"].config, StorageConfig("local", str(store / "g2")), path="copied", ignore=("schema.json",))
    assert not any("schema.json" in r.source for r in left.collect())
    blocked = store / "file"
    blocked.write_text("not a folder")
    failing = storage.copy(spark, d["train"].config, StorageConfig("local", str(blocked)), path="copied")
    with pytest.raises(OSError):
        storage.raise_failed(failing)
    assert storage.copy(spark, d["train"].config, goal, path="absent").count() == 0


def test_storage_options():
    s = StorageConfig("s3", "bucket/x", {"key": "a", "aws_secret_access_key": "b", "client_kwargs": {"endpoint_url": "http://h", "region_name": "r"}})
    o = s.hadoop_options()
    assert s.uri == "s3a://bucket/x" and (o["fs.s3a.access.key"], o["fs.s3a.secret.key"], o["fs.s3a.endpoint"], o["fs.s3a.endpoint.region"]) == ("a", "b", "http://h", "r")
    assert StorageConfig("gcs", "gs://b").uri == "gs://b"
    with pytest.raises(ValueError):
        StorageConfig("ftp", "x")


def test_export(store):
    d = load_dataset("sent", schema=SCHEMA)
    d["train"].write(data(12))
    sink = MemorySink("import", vector="vector")
    assert d.export(sink, mode="import", destination=StorageConfig("local", str(store / "out"))) == 12
    assert sink.search("sent", [d["train"].read("full").vector[0]], 1) == [[d["train"].read("full").id[0]]]
    assert d.export(MemorySink("insert"), batch_rows=5) == 12
    with pytest.raises(ValueError):
        d.export(sink, mode="push")

    class Failing(MemorySink):
        def import_state(self, job):
            return "failed", "no room"

    with pytest.raises(RuntimeError, match="no room"):
        d.export(Failing("f"), mode="import", destination=StorageConfig("local", str(store / "out2")))


def test_harness(spark):
    sink = MemorySink("bench")
    sink.connect()
    sink.create_collection("c", harness.collection(4))
    sink.insert("c", [{"embedding": [0.0] * 4}, {"embedding": [1.0] * 4}])
    assert sink.search("c", [[0.9] * 4], 1) == [[1]]
    assert harness.benchmark_insert(spark, sink, "c", 50, 4, num_rounds=2)["per_second"] > 0
    assert harness.benchmark_search(sink, "c", 5, 4, num_rounds=1)["deviation"] == 0.0
    assert harness.benchmark_mixed_workload(sink, "c", 5, 5, 4, duration=0.05)["inserts_per_second"] > 0


def test_inserts_from_workers_arrive(spark, tmp_path):
    sink = FolderSink(str(tmp_path / "sink"))
    result = harness.benchmark_insert(spark, sink, "bench", 500, 4, batch_size=100, num_rounds=1)
    assert sink.count("bench") == 500 and result["per_second"] > 0
    sink.create_collection("bench", harness.collection(4))
    assert sink.count("bench") == 0 and sink.search("bench", [[0.0] * 4], 2) == [[]]
    sink.insert("bench", [{"id": k, "embedding": [float(k)] * 4} for k in range(5)])
    assert sink.search("bench", [[3.2] * 4], 2) == [[3, 4]]


def test_few_rows_make_few_files(store, spark):
    d = load_dataset("few", "train", SCHEMA)
    rows = spark.range(40).selectExpr("id", "array(0f, 0f, 0f, 0f) AS vector", "'x' AS text").repartition(20)
    d.write(rows)
    assert d.get_num_files() == 1 and d.get_num_rows() == 40


def test_streaming(store, spark):
    valid = Schema((Field("id", Kind.INT64, is_primary=True), Field("text", Kind.VARCHAR, max_length=3)))
    inbox = str(store / "inbox")
    ok, bad, cp = (str(store / x) for x in ("ok", "bad", "cp"))
    for k, rows in enumerate(([(1, "abc"), (2, "abcd")], [(3, None), (4, "a")])):
        spark.createDataFrame(rows, "id bigint, text string").coalesce(1).write.mode("append").parquet(inbox)
        q = ingest.ingest(ingest.source(spark, inbox, valid), valid, ok, bad, cp)
        q.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(ok).collect()) == [1, 4]
    assert sorted((r.pk, r.rule) for r in spark.read.parquet(bad).collect()) == [("2", "max_length"), ("3", "required")]


def test_logger():
    log = configure_logger("WARNING")
    assert log.level == 30 and len(configure_logger("DEBUG").handlers) == 1
