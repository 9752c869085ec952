"""Scans, sinks and streams: round trips."""

import json

import pytest

from corvane.sources import io
from corvane.streaming import events


def test_slices():
    assert io.parse_slice("train[:1000]") == ("train", 0, 1000)
    assert io.parse_slice("test[5:9]") == ("test", 5, 9)
    assert io.parse_slice("train") == ("train", None, None)
    with pytest.raises(ValueError):
        io.parse_slice("train[5]")


def test_json_arrays_skip_bad_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"problem": "é", "n": 1}, {"problem": "b", "n": 2}]))
    (tmp_path / "b.json").write_text("{not json")
    (tmp_path / "c.json").write_text(json.dumps({"root": 1}))
    got = io.read_json_array(spark, str(tmp_path / "*.json"), "problem:string,n:int").collect()
    assert sorted((r.problem, r.n) for r in got) == [("b", 2), ("é", 1)]


def test_csv_and_conversion(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,problem,correct_answer\n1,"a ""q"", b",007\n')
    df = io.read_csv(spark, str(tmp_path / "x.csv"))
    assert [tuple(r) for r in df.collect()] == [("1", 'a "q", b', "007")]
    io.convert(spark, str(tmp_path / "x.csv"), str(tmp_path / "j"), "csv", "json")
    io.convert(spark, str(tmp_path / "j"), str(tmp_path / "p"), "json", "parquet")
    assert {r.correct_answer for r in io.read_split(spark, str(tmp_path / "p")).collect()} == {"007"}


def test_results_by_type(spark, tmp_path):
    df = spark.createDataFrame([(1, "training"), (2, "statistics")], "id int, data_type string")
    io.save_results(df, str(tmp_path / "t"))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [1]
    io.save_results(df, str(tmp_path / "all"), None, True)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "all")).where("data_type = 'statistics'").collect()] == [2]
    info = json.loads(io.table_info(df, "x"))
    assert info["num_rows"] == 2 and len(info["features"]) == 2
    assert io.timestamped("/a/b").startswith("/a/b_2")


def test_union_fills_missing(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, p string"), spark.createDataFrame([(2, 0.5)], "id int, q double")
    assert sorted(tuple(r) for r in io.union_by_name(a, b).select("id", "p", "q").collect()) == [(1, "x", None), (2, None, 0.5)]


def test_stream_equals_batch(spark, sf_dir):
    batch = events.windowed(events.with_event_time(spark.read.parquet(f"{sf_dir}/events.parquet")), "1 day")
    stream = events.run_to_table(events.windowed(events.with_event_time(events.read_stream(spark, f"{sf_dir}/events*.parquet"), late="1 day"), "1 day"))
    key = lambda r: (str(r.window_start), r.event_type)
    assert sorted(batch.collect(), key=key) == sorted(stream.collect(), key=key)


def test_json_arrays_without_a_schema(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"problem": "é\nx", "n": 1}, 7, {"problem": "b", "m": [2]}], indent=1))
    (tmp_path / "b.json").write_text("[{bad")
    (tmp_path / "c.json").write_text(json.dumps({"root": 1}))
    got = io.read_json_array(spark, str(tmp_path / "*.json"))
    assert sorted(got.columns) == ["m", "n", "problem"] and sorted((r.problem, r.n) for r in got.collect()) == [("b", None), ("é\nx", 1)]


def test_json_array_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None), (3, 'q"')], "id int, p string")
    io.write_json_array(df.repartition(3), str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("part-*"))
    text = files[0].read_text()
    assert len(files) == 1 and "é" in text and sorted((r["id"], r["p"]) for r in json.loads(text)) == [(1, "é"), (2, None), (3, 'q"')]
    io.write_json_array(df.where("id < 0"), str(tmp_path / "none"))
    assert json.loads("".join(f.read_text() for f in (tmp_path / "none").glob("part-*"))) == []


def test_missing_split_is_the_first(spark, tmp_path):
    spark.createDataFrame([(1, "b"), (2, "a")], "id int, split string").write.partitionBy("split").parquet(str(tmp_path / "t"))
    ids = lambda s: [r.id for r in io.read_split(spark, str(tmp_path / "t"), s).collect()]
    assert ids("b") == [1] and ids("validation") == [2] and sorted(ids(None)) == [1, 2]


def test_logs_snapshots_and_settings(spark, tmp_path):
    io.append_log(spark, str(tmp_path / "log"), ["a", "b"])
    io.append_log(spark, str(tmp_path / "log"), ["c"])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect()) == ["a", "b", "c"]
    io.write_snapshot(spark.createDataFrame([("x", 1.5)], "name string, mean double"), str(tmp_path / "snap"))
    got = spark.read.json(str(tmp_path / "snap")).first()
    assert got["mean"] == 1.5 and got.saved_at
    a, b = spark.createDataFrame([(1, "x")], "id int, p string"), spark.createDataFrame([(2, 0.5)], "id int, q double")
    io.save_all(str(tmp_path / "all"), a, b)
    assert sorted(spark.read.parquet(str(tmp_path / "all")).columns) == ["id", "p", "q"]
    assert io.settings(spark, {"batch": "8"}) == {"batch": "8"}


def test_tables_of_a_scope(spark):
    from corvane.sources import store

    df = spark.range(3)
    with store.scratch(spark) as outer:
        with store.scratch(spark) as inner:
            gone, kept = store.materialise(df), inner.keep(store.materialise(df))
        assert not store.path_exists(spark, gone._corvane_path) and kept.count() == 3
        final = outer.keep(store.materialise(kept))
    assert not store.path_exists(spark, kept._corvane_path) and final.count() == 3
    with pytest.raises(ValueError), store.scratch(spark) as s:
        lost = s.keep(store.materialise(df))
        raise ValueError
    assert not store.path_exists(spark, lost._corvane_path)
    store.drop_table(final)
    assert not store.path_exists(spark, final._corvane_path)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from corvane.sources import store

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        store.shared_dir(session)
