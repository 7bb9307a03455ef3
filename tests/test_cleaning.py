from datetime import datetime

from pyspark.sql import functions as F

from segmill.functions import scalars
from segmill.operators import cleaning
from segmill.sources import csv_events

T0 = datetime(2020, 1, 5, 10, 0, 0)


def normalised(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(scalars.normalise_text(F.col("v"))).collect()]


def test_normalise_text(spark):
    given = ["\t Acme \n", "NaN", " nan ", "", "   ", None, "A "]
    assert normalised(spark, given) == ["acme", "unknown", "unknown", "unknown", "unknown", "unknown", "a"]


def test_category_levels(spark):
    paths = ["a", "a.b.c.d.e", "a..b", "", None]
    df = spark.createDataFrame([(p, "x") for p in paths], "category_code string, brand string")
    done = cleaning.fill_category_levels(cleaning.split_category(cleaning.normalise_strings(df)))
    assert [tuple(r)[1:] for r in done.collect()] == [
        ("a", "unknown", "unknown", "unknown", None),
        ("a", "b", "c", "d", "e"),
        ("a", "", "b", "unknown", None),
        ("unknown", "unknown", "unknown", "unknown", None),
        ("unknown", "unknown", "unknown", "unknown", None),
    ]


def raw(spark, rows):
    return spark.createDataFrame(
        rows,
        "ordinal long, event_time timestamp, event_type string, product_id long, category_id long, "
        "category_code string, brand string, price float, user_id long, user_session string",
    )


def test_first_copy_without_price_takes_the_key_with_it(spark):
    rows = [
        (1, T0, "view", 1, 0, "a", "x", None, 7, "s"),
        (2, T0, "view", 1, 0, "a", "x", 5.0, 7, "s"),
        (3, T0, "cart", 1, 0, "a", "x", 6.0, 7, "s"),
        (4, T0, "cart", 1, 0, "a", "y", 9.0, 7, "s"),
        (5, T0, "purchase", 1, 0, "a", "y", 9.0, 7, None),
    ]
    done = cleaning.clean_events(raw(spark, rows)).collect()
    assert [(r["event_type"], r["brand"], r["price"]) for r in done] == [("cart", "x", 6.0)]


def test_hot_copies_collapse_before_the_shuffle(spark):
    df = raw(spark, [(1, T0, "view", 1, 0, "a", "x", 5.0, 7, "s")])
    many = spark.range(60_000).withColumnRenamed("id", "ordinal").join(F.broadcast(df.drop("ordinal")))
    kept = cleaning.dedup_events(many.select(df.columns))
    assert [r["ordinal"] for r in kept.collect()] == [0]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


HEADER = "event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session\n"


def write(folder, name, *lines):
    (folder / name).write_text(HEADER + "".join(line + "\n" for line in lines))


def test_ingest_folder(spark, tmp_path):
    write(
        tmp_path,
        "a.csv",
        "2019-10-01 00:00:00 UTC,view,1,10,x.y,Acme,1.5,7,s1",
        "2019-10-01 00:00:00 UTC,view,1,10,x.y,Late,2.5,7,s1",
        "2019-10-01 00:00:01 UTC,cart,1,,a.b.c.d.e, ACME ,NA,7,s1",
        "2019-10-01 00:00:02 UTC,purchase,1,10,,null,3.5,7,s1",
        "not a time,view,1,10,x,Acme,1.5,7,s1",
        "2019-10-01 00:00:03 UTC,view,1,10,x,Acme,cheap,7,s1",
        "2019-10-01 00:00:04 UTC,view,1,10,x,Acme,1.5,,s1",
        "2019-10-01 00:00:05 UTC,view,1,10,x,Acme,1.5,7,s1,extra,fields",
        "2019-10-01T00:00:06Z,view,2,10,a.b.c.d.e,Acme,1.5,8,s2",
    )
    write(tmp_path, "b.csv", "2019-10-01 00:00:00 UTC,view,1,10,x.y,Other file,9.5,7,s1")
    (tmp_path / "notes.txt").write_text("not a table\n")

    per_file = csv_events.ingest_folder(spark, str(tmp_path)).orderBy("event_time", "price").collect()
    assert [(r["event_type"], r["brand"], r["price"], r["category_code_1"]) for r in per_file] == [
        ("view", "acme", 1.5, "x"),
        ("view", "other file", 9.5, "x"),
        ("purchase", "unknown", 3.5, "unknown"),
        ("view", "acme", 1.5, "a"),
    ]
    together = csv_events.ingest_folder(spark, str(tmp_path), scope="global")
    assert sorted(r["brand"] for r in together.collect()) == ["acme", "acme", "unknown"]

    scanned = csv_events.scan_events_csv(spark, str(tmp_path))
    reasons = {r["reject_reason"]: r["raw_row"] for r in csv_events.rejected_rows(scanned).collect()}
    assert set(reasons) == {"bad event_time", "bad price", "missing user_id", "malformed row"}
    assert "cheap" in reasons["bad price"]

    report = {r["source_file"][-5:]: r for r in csv_events.ingest_report(scanned).collect()}
    a, b = report["a.csv"], report["b.csv"]
    assert (a["rows_read"], a["rows_rejected"], a["rows_too_deep"], a["rows_inserted"]) == (9, 4, 2, 3)
    assert (b["rows_read"], b["rows_rejected"], b["rows_too_deep"], b["rows_inserted"]) == (1, 0, 0, 1)


def test_first_copy_across_splits_of_a_file(spark, tmp_path):
    line = "2019-10-01 00:00:00 UTC,view,1,10,x.y,b{},1.5,7,s1"
    write(tmp_path, "a.csv", *[line.format(i) for i in range(3000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        scanned = csv_events.scan_events_csv(spark, str(tmp_path))
        assert scanned.rdd.getNumPartitions() > 4
        assert [r["brand"] for r in csv_events.clean_scanned(scanned).collect()] == ["b0"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_columns_by_header_name_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "brand,user_session,event_time,note,user_id,product_id,event_type,price,category_code,category_id\n"
        '"Ac""me, Inc",s1,2019-10-01 00:00:00 UTC,x,7,1,view,1.5,x.y,10\n'
        '"back\\slash",s1,2019-10-01 00:00:01 UTC,x,8,2,view,2.5,a.b.c.d.e.f,10\n'
    )
    write(tmp_path, "b.csv", "2019-10-01 00:00:02 UTC,view,3,10,x,plain,3.5,9,s2")
    (tmp_path / "c.csv").write_text("event_time,brand\n2019-10-01 00:00:00 UTC,lost\n")
    (tmp_path / "empty.csv").write_text("")
    scanned = csv_events.scan_events_csv(spark, str(tmp_path))
    good = csv_events.accepted_rows(scanned).orderBy("user_id")
    assert [tuple(r) for r in good.select("brand", "user_id", "product_id", "price", "user_session").collect()] == [
        ('Ac"me, Inc', 7, 1, 1.5, "s1"),
        ("back\\slash", 8, 2, 2.5, "s1"),
        ("plain", 9, 3, 3.5, "s2"),
    ]
    assert [r["reject_reason"] for r in csv_events.rejected_rows(scanned).collect()] == ["missing event_type"]
    events = csv_events.ingest_folder(spark, str(tmp_path)).orderBy("user_id").collect()
    assert [r["category_rest"] for r in events] == [None, "e.f", None]


def test_line_breaks_in_quoted_fields(spark, tmp_path):
    row = '2019-10-01 00:00:0{} UTC,view,{},10,x,{},3.5,9,s'
    write(tmp_path, "a.csv", row.format(1, 1, '"two\nlines ""quoted"""'), row.format(2, 2, "plain"))
    # a quote that is never closed spoils its own line only
    write(tmp_path, "b.csv", row.format(3, 3, '"open'), row.format(4, 4, "fine"))
    scanned = csv_events.scan_events_csv(spark, str(tmp_path))
    good = {r["product_id"]: r["brand"] for r in csv_events.accepted_rows(scanned).collect()}
    assert good == {1: 'two\nlines "quoted"', 2: "plain", 4: "fine"}
    assert [r["reject_reason"] for r in csv_events.rejected_rows(scanned).collect()] == ["malformed row"]
