import gzip
import shutil

from segmill import jobs
from segmill.session import shuffle_partitions
from segmill.sources import csv_events, stored_keys, tables
from segmill.streaming.ingest import ingest_files
from test_cleaning import write


def test_from_csv_to_segments(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    for month in (1, 2):
        write(
            folder,
            f"{month}.csv",
            *[
                f"2020-0{month}-{1 + i % 28:02d} {i % 24:02d}:00:00 UTC,{['view', 'cart', 'purchase'][i % 3]},"
                f"{i % 11},5,cat{i % 4}.x,brand{i % 7},{i % 13}.5,{i % 40},s{i % 40}-{i % 3}"
                for i in range(400)
            ],
            "broken line",
        )
    events, client = str(tmp_path / "events"), str(tmp_path / "client")
    report = jobs.ingest(spark, str(folder), events, str(tmp_path / "bad")).collect()
    stored = tables.read_events(spark, events)
    assert sum(r["rows_inserted"] for r in report) == stored.count() > 700
    assert [r["rows_rejected"] for r in report] == [1, 1]
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 2

    # nothing new: nothing changes; a batch that never got its report is done again
    assert jobs.ingest(spark, str(folder), events, str(tmp_path / "bad")).count() == 0
    assert tables.read_events(spark, events).count() == stored.count()
    write(folder, "3.csv", "2020-02-29 00:00:00 UTC,view,1,5,a,b,1.5,1,s1-1", "broken")
    paths = [p for p in csv_events.csv_files(spark, str(folder)) if p.endswith("3.csv")]
    lost = str(tmp_path / "lost")
    ingest_files(spark, paths, events, str(tmp_path / "bad"), lost, 1)
    again = jobs.ingest(spark, str(folder), events, str(tmp_path / "bad")).collect()
    assert [(r["rows_read"], r["rows_inserted"]) for r in again] == [(2, 1)]
    after = tables.read_events(spark, events).count()
    assert after == sum(r["rows_inserted"] for r in report) + 1
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 3

    jobs.customers(spark, events, client, "2020-03-01")
    assert tables.read_customers(spark, client).count() == 40

    out, centres = str(tmp_path / "out"), str(tmp_path / "centres")
    jobs.segments(spark, client, str(tmp_path / "model"), centres, out, k=3)
    scatter = spark.read.parquet(out)
    assert scatter.columns == ["id_client", "label", "pc1", "pc2"] and scatter.count() == 40
    assert tables.load_centres(spark, centres).count() == 3

    # the stored model and centres label an id range as the run did
    jobs.label(spark, client, str(tmp_path / "model"), centres, str(tmp_path / "labels"), 5, 14)
    labels = {r["id_client"]: r["cluster"] for r in spark.read.parquet(str(tmp_path / "labels")).collect()}
    assert sorted(labels) == list(range(5, 15))
    assert labels.items() <= {r["id_client"]: r["label"] for r in scatter.collect()}.items()

    jobs.density_labels(spark, client, str(tmp_path / "density"), min_size=3)
    assert spark.read.parquet(str(tmp_path / "density")).count() == 40


def test_shuffle_partitions():
    assert shuffle_partitions(0) == 200
    assert shuffle_partitions(10**12) == 932
    assert shuffle_partitions(10**14) == 93_133


def test_events_are_stored_once_over_batches(spark, tmp_path):
    folder, events = tmp_path / "csv", str(tmp_path / "events")
    folder.mkdir()

    def lines(numbers, brand):
        return [f"2020-0{1 + i % 3}-05 00:00:{i % 60:02d} UTC,view,{i},5,x,{brand},1.5,{i},s" for i in numbers]

    def run(scope="global"):
        return jobs.ingest(spark, str(folder), events, str(tmp_path / "bad"), scope).collect()

    write(folder, "1.csv", *lines(range(500), "one"))
    assert [r["rows_inserted"] for r in run()] == [500]
    write(folder, "2.csv", *lines(range(300, 700), "two"))
    assert [r["rows_inserted"] for r in run()] == [200]
    # a batch without filters, as older tables have them
    shutil.rmtree(f"{events}_keys/ingest_batch=0")
    write(folder, "3.csv", *lines(range(0, 900, 2), "three"))
    assert [r["rows_inserted"] for r in run()] == [100]
    stored = tables.read_events(spark, events)
    assert stored.count() == stored.select("product_id").distinct().count() == 800
    # within a file only: copies of other batches come in
    write(folder, "4.csv", *lines(range(10), "four"))
    assert [r["rows_inserted"] for r in run("file")] == [10]


def test_only_months_concerned_are_read(spark, tmp_path):
    events = str(tmp_path / "events")
    folder = tmp_path / "csv"
    folder.mkdir()
    write(folder, "1.csv", *[f"2020-{m:02d}-05 00:00:00 UTC,view,{m},5,x,b,1.5,1,s" for m in range(1, 13)])
    jobs.ingest(spark, str(folder), events, str(tmp_path / "bad"))
    keys = stored_keys.stored_keys(spark, events, ["202002", "202003"], {0})
    assert keys.count() == 2
    plan = keys._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "202002" in pruned and "202003" in pruned
    assert "category_code_1" not in plan.split("ReadSchema")[1]


def test_one_bad_file_does_not_stop_the_rest(spark, tmp_path):
    folder, events = tmp_path / "csv", str(tmp_path / "events")
    (folder / "d.csv").mkdir(parents=True)
    line = "2020-01-05 00:00:00 UTC,view,{},5,x,b,1.5,1,s"
    for i in range(5):
        write(folder, f"{i}.csv", line.format(i))
    (folder / "empty.csv").write_text("")
    write(folder, "header.csv")
    # a packed file under a name that says nothing of it
    (folder / "packed.csv").write_bytes(gzip.compress((folder / "0.csv").read_bytes()))
    bad = tmp_path / "bad"
    report = {r["source_file"].rsplit("/", 1)[1]: r for r in jobs.ingest(spark, str(folder), events, str(bad)).collect()}
    assert {n: r["failure"] for n, r in report.items() if r["failure"]} == {
        "d.csv": "not a file",
        "empty.csv": "empty file",
        "packed.csv": "no known column",
    }
    assert sum(r["rows_inserted"] for r in report.values()) == 5
    assert report["header.csv"]["rows_read"] == 0
    # nothing is tried twice
    assert jobs.ingest(spark, str(folder), events, str(bad)).count() == 0


def test_files_that_fail_while_they_are_read(spark, tmp_path, monkeypatch):
    """Reads that fail are halved until the files are found that fail alone."""
    for i in range(7):
        write(tmp_path, f"{i}.csv", f"2020-01-05 00:00:00 UTC,view,{i},5,x,b,1.5,1,s")
    inventory = csv_events.file_inventory

    def failing(spark, paths):
        # as after a file has gone
        gone = [p.replace("3.csv", "gone.csv").replace("5.csv", "lost.csv") for p in paths]
        return inventory(spark, gone)

    monkeypatch.setattr(csv_events, "file_inventory", failing)
    scanned, files = csv_events.land_scanned(spark, csv_events.csv_files(spark, str(tmp_path)))
    assert sorted(r["product_id"] for r in scanned.collect()) == [0, 1, 2, 4, 6]
    failed = {name.rsplit("/", 1)[1]: why for name, why in files if why}
    assert set(failed) == {"3.csv", "5.csv"} and "gone.csv" in failed["3.csv"]
