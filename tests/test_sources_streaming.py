import json

import pytest

from seriesloom.sources import files as fs


def test_dated_csv_and_monthly(spark, tmp_path):
    (tmp_path / "fred_A.csv").write_text("date,value\n2020-01-31,1.5\n2020-02-01,x\n2020-02-29,2\nshort\n2020-04-30,3\n2020-03-31,2.5\n")
    (tmp_path / "fred_B.csv").write_text('date,value\r\n"2020-01-01","7"\r\n')
    s = fs.read_dated_csv(spark, str(tmp_path), "fred_")
    rows = [(r.key, str(r.date), r.x) for r in s.orderBy("key", "pos").collect()]
    assert rows == [("A", "2020-01-31", 1.5), ("A", "2020-02-29", 2.0), ("A", "2020-04-30", 3.0), ("A", "2020-03-31", 2.5), ("B", "2020-01-01", 7.0)]
    m = {(r.key, str(r.month)): r.x for r in fs.monthly_source(spark, str(tmp_path), "fred_").collect()}
    assert m[("A", "2020-03-31")] == 2.5 and m[("B", "2020-01-01")] == 7.0
    assert fs.list_series(spark, str(tmp_path), "fred_") == ["A", "B"] and fs.list_series(spark, str(tmp_path / "none")) == []


def test_documents_logs_and_store(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"n": 3, "deep": {"x": 1.5}}, indent=1))
    assert fs.read_documents(spark, str(tmp_path / "a.json"), "n int, deep struct<x: double>").first().deep.x == 1.5
    (tmp_path / "log.jsonl").write_text('{"id": "F-001", "v": 1}\nbroken\n{"id": "F-002", "v": 2}\n')
    log = fs.read_log(spark, str(tmp_path / "log.jsonl"), "id string, v int")
    assert log.filter("id = 'F-001'").first().v == 1 and log.count() == 3
    want = spark.range(5).withColumn("cache_key", fs.content_key("id"))
    store = str(tmp_path / "store")
    assert fs.missing_work(want, store).count() == 5
    fs.append_results(want.filter("id < 2"), store)
    assert sorted(r.id for r in fs.missing_work(want, store).collect()) == [2, 3, 4]
    fs.write_report(want, str(tmp_path / "report"))
    fs.write_corpus(want.selectExpr("id", "id % 2 as concept"), str(tmp_path / "corpus"))
    assert spark.read.parquet(str(tmp_path / "corpus")).filter("concept = 1").count() == 2
    with pytest.raises(FileNotFoundError, match="run the build"):
        fs.require(spark, str(tmp_path / "nope"), "run the build")


def test_stream_equals_batch(spark, sf_dir):
    from seriesloom.plans.kernel_queries import x21_stream_hourly, x22_stream_delay_vectors
    from seriesloom.runtime import table

    e = table(spark, sf_dir, "events")
    assert x21_stream_hourly(spark, sf_dir).agg({"n": "sum"}).first()[0] == e.count()
    assert x22_stream_delay_vectors(spark, sf_dir).count() == sum(max(r["count"] - 2, 0) for r in e.groupBy("user_id").count().collect())


def test_roots_and_resumed_work(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("SERIES_ROOT", raising=False)
    (tmp_path / "b").mkdir()
    assert fs.first_root(spark, "SERIES_ROOT", str(tmp_path / "a"), str(tmp_path / "b")) == str(tmp_path / "b")
    (tmp_path / "c").mkdir()
    monkeypatch.setenv("SERIES_ROOT", str(tmp_path / "c"))
    assert fs.first_root(spark, "SERIES_ROOT", str(tmp_path / "b")) == str(tmp_path / "c")
    monkeypatch.setenv("SERIES_ROOT", str(tmp_path / "gone"))
    with pytest.raises(FileNotFoundError, match="SERIES_ROOT"):
        fs.first_root(spark, "SERIES_ROOT", str(tmp_path / "gone"))
    store, counted = str(tmp_path / "work"), []

    def compute(todo):
        counted.append(todo.count())
        return todo.selectExpr("cache_key", "id * 2 as twice")

    want = spark.range(6).withColumn("cache_key", fs.content_key("id"))
    assert fs.resumed(want.filter("id < 4"), store, compute).count() == 4
    assert sorted(r.twice for r in fs.resumed(want, store, compute).collect()) == [0, 2, 4, 6, 8, 10]
    assert fs.resumed(want, store, compute).count() == 6 and counted == [4, 2]  # nothing is computed twice


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from seriesloom import runtime

    empty = SimpleNamespace(isEmpty=lambda: True)
    context = SimpleNamespace(master="yarn", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: empty)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)))
