import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from segmill.operators.clustering import centres_from_frame
from segmill.sources.csv_events import ingest_folder
from segmill.schemas import EVENTS_SCHEMA
from segmill.streaming import ingest
from segmill.streaming.ingest import read_streamed_events, stream_ingest
from segmill.streaming.minibatch import read_centres, stream_minibatch_kmeans
from test_cleaning import write


def test_ingest_takes_each_file_once(spark, tmp_path):
    folder, table, offsets = tmp_path / "csv", str(tmp_path / "events"), str(tmp_path / "offsets")
    folder.mkdir()
    line = "2019-1{}-01 00:00:0{} UTC,view,1,10,x.y,Acme{},1.5,7,s1"
    # a late file and copies within and between files
    write(folder, "a.csv", line.format(1, 0, "a"), line.format(1, 0, "b"))
    write(folder, "b.csv", line.format(0, 1, "c"), line.format(1, 0, "d"))
    stream_ingest(spark, str(folder), table, offsets, files_per_batch=1).awaitTermination()
    write(folder, "c.csv", line.format(0, 2, "e"))
    stream_ingest(spark, str(folder), table, offsets, files_per_batch=1).awaitTermination()

    streamed = read_streamed_events(spark, table)
    assert sorted(r["brand"] for r in streamed.collect()) == ["acmea", "acmec", "acmed", "acmee"]
    batch = ingest_folder(spark, str(folder))
    assert streamed.select(*EVENTS_SCHEMA.names).exceptAll(batch).isEmpty()
    assert streamed.select("ingest_batch").distinct().count() == 3


def test_ingest_keeps_bad_rows_and_reports(spark, tmp_path):
    folder, table = tmp_path / "csv", str(tmp_path / "events")
    folder.mkdir()
    write(folder, "a b.csv", "2019-10-01 00:00:00 UTC,view,1,10,x.y,A,1.5,7,s1", "broken", "no,,,,,,,,")
    (folder / "b.csv").write_text(
        "user_session,user_id,price,brand,category_code,category_id,product_id,event_type,event_time\n"
        "s2,8,2.5,B,x,1,2,cart,2019-10-01 00:00:01 UTC\n"
    )
    stream_ingest(spark, str(folder), table, str(tmp_path / "offsets")).awaitTermination()
    stored = read_streamed_events(spark, table)
    assert sorted((r["user_id"], r["brand"]) for r in stored.collect()) == [(7, "a"), (8, "b")]
    bad = spark.read.parquet(f"{table}_quarantine")
    assert bad.count() == 2 and {r["ingest_batch"] for r in bad.collect()} == {0}
    report = spark.read.parquet(f"{table}_report").orderBy("rows_read").collect()
    assert [(r["rows_read"], r["rows_rejected"], r["rows_inserted"]) for r in report] == [(1, 0, 1), (3, 2, 1)]


def test_minibatch_waits_for_enough_rows(spark, tmp_path):
    matrix, centres, offsets = (str(tmp_path / n) for n in ("matrix", "centres", "offsets"))
    for i in range(4):
        row = [(i, Vectors.dense([float(i), 0.0]))]
        spark.createDataFrame(row, ["id_client", "features"]).coalesce(1).write.mode("append").parquet(matrix)
    stream_minibatch_kmeans(spark, matrix, centres, offsets, k=3, files_per_batch=1).awaitTermination()
    found, weights = centres_from_frame(read_centres(spark, centres))
    assert len(found) == 3 and sum(weights) == 4


def test_minibatch_versions(spark, tmp_path):
    matrix, centres, offsets = (str(tmp_path / n) for n in ("matrix", "centres", "offsets"))
    rows = [(i, Vectors.dense([float(i % 2) * 10, float(i % 5)])) for i in range(100)]
    table = spark.createDataFrame(rows, ["id_client", "features"])
    table.repartition(4).write.parquet(matrix)
    stream_minibatch_kmeans(spark, matrix, centres, offsets, k=2, files_per_batch=1).awaitTermination()
    found, weights = centres_from_frame(read_centres(spark, centres))
    assert sum(weights) == 100
    assert sorted(round(c[0]) for c in found) == [0, 10]
    versions = spark.read.parquet(centres).groupBy("batch").agg(F.sum("weight").alias("w")).orderBy("batch").collect()
    assert [r["w"] for r in versions] == sorted(r["w"] for r in versions) and len(versions) == 4


def test_copies_over_files_and_batches(spark, tmp_path):
    folder, table, offsets = tmp_path / "csv", str(tmp_path / "events"), str(tmp_path / "offsets")
    folder.mkdir()
    line = "2019-11-{:02d} 00:00:00 UTC,{},1,10,x.y,{},{},7,s1"

    def run(**files):
        for name, lines in files.items():
            write(folder, f"{name}.csv", *lines)
        stream_ingest(spark, str(folder), table, offsets, lateness="3 days").awaitTermination()

    # two copies in a file; a first copy without a price takes its key with it
    run(a=[line.format(1, "view", "A", 1.5), line.format(1, "view", "B", 2), line.format(2, "cart", "C", "")])
    # copies in another batch, one of them of the priceless one; a row that is new
    run(b=[line.format(1, "view", "D", 3), line.format(2, "cart", "E", 4), line.format(9, "view", "F", 5)])
    # 6 November is three days behind the 9th: too late; the 7th is not
    run(c=[line.format(6, "view", "G", 6), line.format(7, "view", "H", 7)], d=[line.format(9, "view", "I", 8)])
    stored = read_streamed_events(spark, table)
    assert sorted(r["brand"] for r in stored.collect()) == ["a", "f", "h"]
    late = spark.read.parquet(f"{table}_quarantine").collect()
    assert [r["reject_reason"] for r in late] == ["later than the watermark"]
    assert '"brand":"G"' in late[0]["raw_row"]
    report = spark.read.parquet(f"{table}_report").collect()
    found = {r["source_file"][-5]: (r["rows_read"], r["rows_rejected"], r["rows_inserted"]) for r in report}
    assert found == {"a": (3, 0, 1), "b": (3, 0, 1), "c": (2, 1, 1), "d": (1, 0, 0)}
    # nothing new: nothing changes
    run()
    assert read_streamed_events(spark, table).count() == 3


def test_restart_between_landing_and_storing(spark, tmp_path, monkeypatch):
    """A batch that failed after its rows had landed is finished by the next run, once."""
    folder, table, offsets = tmp_path / "csv", str(tmp_path / "events"), str(tmp_path / "offsets")
    folder.mkdir()
    line = "2019-11-{:02d} 00:00:00 UTC,view,1,10,x.y,{},1.5,7,s1"
    write(folder, "a.csv", line.format(1, "A"))
    stream_ingest(spark, str(folder), table, offsets, lateness="3 days").awaitTermination()
    write(folder, "b.csv", line.format(1, "B"), line.format(2, "C"))

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(ingest, "_report_landed", fail)
        with pytest.raises(Exception, match="lost"):
            stream_ingest(spark, str(folder), table, offsets, lateness="3 days").awaitTermination()
    with monkeypatch.context() as patched:
        patched.setattr(ingest, "land_scanned", fail)
        stream_ingest(spark, str(folder), table, offsets, lateness="3 days").awaitTermination()
    assert sorted(r["brand"] for r in read_streamed_events(spark, table).collect()) == ["a", "c"]
    report = spark.read.parquet(f"{table}_report").collect()
    assert {r["source_file"][-5]: r["rows_inserted"] for r in report} == {"a": 1, "b": 1}


def test_parts_of_the_streamed_csv_are_written_by_several_tasks(spark, tmp_path):
    """One task per part would take the longer the more events there are, on any cluster."""
    from pyspark.sql import functions as F

    from segmill.plans import queries, settings
    from segmill.sources.csv_events import read_raw

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        queries._written_csv(spark, "/root/testdata/sf0.001", str(tmp_path / "csv"), (0, 1), settings.STREAMED_FILES)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = [str(f) for f in (tmp_path / "csv").glob("*/*.csv")]
    assert 2 < len(files) <= 2 * settings.STREAMED_FILES
    rows = read_raw(spark, files)
    spread = rows.groupBy("event_time", "user_id", "product_id").agg(F.countDistinct("source_file").alias("n"))
    assert spread.where("n > 1").count() == 0
