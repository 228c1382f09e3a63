import pytest

from millrace.operators import partitioners
from millrace.settings import Settings
from millrace.sources import readers, sinks


def test_text_adjacency(spark, tmp_path):
    (tmp_path / "g.txt").write_text("1,a|2,1.5;3\n2\n\n3|1,2\n")
    g = readers.read_adjacency(spark, str(tmp_path / "g.txt"))
    assert {tuple(r) for r in g.vertices.collect()} == {(1, "a"), (2, None), (3, None)}
    assert {tuple(r) for r in g.edges.collect()} == {(1, 2, 1.5), (1, 3, None), (3, 1, 2.0)}
    lines = {r["line"] for r in readers.adjacency_lines(g).collect()}
    assert lines == {"1|2,1.5;3", "2", "3|1,2"}


def test_bad_text_fails(spark, tmp_path):
    (tmp_path / "g.txt").write_text("1|x,1\n")
    with pytest.raises(Exception):  # noqa: B017
        readers.read_adjacency(spark, str(tmp_path / "g.txt")).edges.collect()


@pytest.mark.parametrize("coordinates", [True, False])
def test_binary(spark, tmp_path, coordinates):
    rows = [(1, 48.5, 9.0, [(2, 1.5), (3, 2.0)]), (2, 48.6, 9.1, []), (3, 0.0, 0.0, [(1, 4.0)])]
    (tmp_path / "part-0.bin").write_bytes(readers.binary_bytes(rows, coordinates))
    g = readers.read_binary(spark, str(tmp_path / "part-0.bin"), coordinates)
    assert {tuple(r) for r in g.edges.collect()} == {(1, 2, 1.5), (1, 3, 2.0), (3, 1, 4.0)}
    assert {tuple(r) for r in g.vertices.collect()} == ({(1, 48.5, 9.0), (2, 48.6, 9.1), (3, 0.0, 0.0)} if coordinates else {(1,), (2,), (3,)})


def test_workload_and_settings(spark, tmp_path):
    (tmp_path / "w.txt").write_text("start\t1\t2\tnote\nwait\t5\nstart\t3\t4\nstart\t5\t6\nwaitall\nwaitall\nstart\t7\t8\nodd\n")
    assert [tuple(r) for r in readers.read_workload(spark, str(tmp_path / "w.txt"), 2).orderBy("query_id").collect()] == [(0, 0, 1, 2), (1, 0, 3, 4), (2, 1, 5, 6), (3, 2, 7, 8)]
    s = Settings().override(["MAX_PARALLEL_QUERIES = 4", "# note", "search_next_tag = false", "LsruDeltaThresholdNeg=-0.2"])
    assert (s.max_parallel_queries, s.search_next_tag, s.locality_drop) == (4, False, -0.2)
    assert Settings().override(s.lines()) == s
    assert Settings().override(["PlotWorkerStats = true"], strict=False).others == {"PlotWorkerStats": "true"}
    with pytest.raises(KeyError):
        s.override(["nothing = 1"])


def test_stats_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("A;B;\n1;10;\n2;20;\n3;60;\n")
    rows = readers.read_stats_csv(spark, str(tmp_path / "s.csv"))
    assert [tuple(r) for r in rows.orderBy("row_no").collect()] == [(0, 1.0, 10.0), (1, 2.0, 20.0), (2, 3.0, 60.0)]
    assert readers.value_at(rows, "B", 2) == 60.0
    assert [tuple(r) for r in readers.column_dataset(rows, "A", 10, "x", 1).orderBy("row_no").collect()] == [(1, 20.0), (2, 30.0)]


def test_hotspots(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Aa;100\nDd;70\nBb;50\nCc;60\n")
    (tmp_path / "c.csv").write_text("aa;1.0;1.0\nbb;5.0;5.0\ncc;9.0;9.0\n")
    spots = readers.read_hotspots(spark, str(tmp_path / "s.csv"), str(tmp_path / "c.csv"), 3)
    assert [(r["spot"], r["name"]) for r in spots.orderBy("spot").collect()] == [(0, "Aa"), (1, "Bb")]
    places = spark.createDataFrame([(1, 4.0, 4.0), (2, 1.5, 1.0), (3, 3.2, 3.2)], "id long, lat double, lon double")
    assert {r["id"]: r["spot"] for r in partitioners.closest_city_of(places, spots).collect()} == {1: 1, 2: 0, 3: 1}
    # 100/10 lets the first spot reach out to a squared distance of 10; the second reaches 5.
    assert {r["id"]: r["spot"] for r in partitioners.hotspot_of(places, spots, 10).collect()} == {1: 1, 2: 0, 3: 0}
    assert {r["id"]: r["part"] for r in partitioners.hotspot(places, spots, 2, 10).collect()} == {1: 1, 2: 0, 3: 0}


def test_vertex_files(spark, tmp_path):
    values = spark.createDataFrame([(0, 1, "a"), (0, 2, None), (1, 3, "c")], "query_id int, id long, value string")
    sinks.write_vertices(values, str(tmp_path / "out"))
    assert {tuple(r) for r in spark.read.text(str(tmp_path / "out")).collect()} == {("1\ta", 0), ("3\tc", 1)}
    sinks.write_vertices(values.limit(0), str(tmp_path / "out"))


def test_tags_do_not_depend_on_partitions(spark):
    v = spark.range(1000).toDF("id")
    a = {tuple(r) for r in readers.assign_tags(v.repartition(7), 0.2, 3).collect()}
    assert a == {tuple(r) for r in readers.assign_tags(v.coalesce(1), 0.2, 3).collect()}
    assert 100 < sum(t >= 0 for _, t in a) < 300


def test_release_deletes_intermediate_results(spark):
    from millrace import runtime

    df = runtime.materialise(spark.range(3).toDF("id"), "test")
    place = df.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    import os

    assert os.path.isdir(place) and runtime.release(spark) >= 1 and not os.path.isdir(place)


def test_spots_keep_the_files_order(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Small;1\nLarge;900\nMid;50\n")
    (tmp_path / "c.csv").write_text("mid;1;1\nsmall;2;2\nlarge;3;3\n")
    spots = readers.read_hotspots(spark, str(tmp_path / "s.csv"), str(tmp_path / "c.csv"), 2)
    assert [(r["spot"], r["name"]) for r in spots.orderBy("spot").collect()] == [(0, "Small"), (1, "Large")]


def test_stats_rows_are_numbered_over_several_pieces(spark, tmp_path):
    (tmp_path / "s.csv").write_text("A;\n" + "".join(f"{i};\n" for i in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        rows = readers.read_stats_csv(spark, str(tmp_path / "s.csv"))
        assert rows.rdd.getNumPartitions() > 2
        assert sorted((r["row_no"], r["A"]) for r in rows.collect()) == [(i, float(i)) for i in range(500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_logs_and_setup(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("10:02 WARN b\n10:00 INFO a\n")
    (tmp_path / "logs" / "b.log").write_text("10:01 ERROR c\nno level\n")
    log = sinks.merged_log(spark, str(tmp_path / "logs"))
    assert [r["line"] for r in log.collect()] == ["10:00 INFO a", "10:01 ERROR c", "10:02 WARN b", "no level"]
    assert {tuple(r) for r in sinks.level_counts(log).collect()} == {("INFO", 1), ("WARN", 1), ("ERROR", 1)}
    sinks.write_setup(spark, Settings(extra_shots=7), str(tmp_path / "setup"), {"plan": "x"})
    lines = [r[0] for r in spark.read.text(str(tmp_path / "setup")).collect()]
    assert "LsruExtraShots = 7" in lines and "plan = x" in lines
