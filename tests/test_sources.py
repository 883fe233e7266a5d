import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cardwatch.sources import SnapshotTable, ingest_csv_folder, read_json_map, read_zip_centroids
from cardwatch.sources.sinks import with_column_comments, write_by_month, write_clustered

HINTS = "id STRING, date TIMESTAMP, amount STRING"


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


def run(spark, tmp_path, **more):
    return ingest_csv_folder(
        spark, str(tmp_path / "in"), str(tmp_path / "raw"), str(tmp_path / "state"), "raw_test", HINTS, **more
    )


def test_ingest_takes_only_new_files(spark, tmp_path):
    put(tmp_path / "in", "a.csv", "id,date,amount,points\n01,2024-01-01 10:00:00,$5.00,3\n02,2024-01-01 11:00:00,$6.00,4\n")
    first = run(spark, tmp_path)
    assert dict(first.dtypes)["points"] == "int" and dict(first.dtypes)["date"] == "timestamp"
    assert [r.id for r in first.orderBy("id").collect()] == ["01", "02"]
    assert first.filter("_rescued_data is not null").count() == 0
    assert first.filter("_source_file like '%a.csv'").count() == 2 and first.filter("_ingested_at is null").count() == 0
    put(tmp_path / "in", "b.csv", "id,date,amount,points\n03,2024-01-02 10:00:00,$7.00,5\n")
    assert run(spark, tmp_path).count() == 3
    assert run(spark, tmp_path).count() == 3


def test_ingest_rescues_what_does_not_fit(spark, tmp_path):
    put(tmp_path / "in", "a.csv", "id,date,amount,points\n01,2024-01-01 10:00:00,$5.00,3\n")
    run(spark, tmp_path)
    put(tmp_path / "in", "b.csv", "id,date,amount,points\n02,someday,$6.00,many\n03,2024-01-02 10:00:00,$7.00,5,extra\n04,,$1.00,\n")
    got = {r.id: r for r in run(spark, tmp_path).collect()}
    assert json.loads(got["02"]._rescued_data) == {"date": "someday", "points": "many"}
    assert got["02"].points is None and got["02"].amount == "$6.00"
    assert "extra" in json.loads(got["03"]._rescued_data)["_damaged_line"] and got["03"].points == 5
    assert got["01"]._rescued_data is None and got["04"]._rescued_data is None


def test_ingest_evolves_by_name(spark, tmp_path):
    put(tmp_path / "in", "a.csv", "id,date,amount\n01,2024-01-01 10:00:00,$5.00\n")
    run(spark, tmp_path)
    put(tmp_path / "in", "b.csv", "id,colour,amount,date\n02,red,$6.00,2024-01-02 10:00:00\n")
    put(tmp_path / "in", "c.csv", "id,date,amount\n03,2024-01-03 10:00:00,$8.00\n")
    got = {r.id: r for r in run(spark, tmp_path).collect()}
    assert (got["01"].colour, got["02"].colour, got["03"].colour) == (None, "red", None)
    assert got["02"].date == datetime(2024, 1, 2, 10) and got["02"].amount == "$6.00"


def test_lookups(spark, tmp_path):
    (tmp_path / "mcc.json").write_text('{\n "5411": "Grocery",\n "5812": "Eating, places"\n}')
    assert {(r.mcc, r.mcc_description) for r in read_json_map(spark, str(tmp_path / "mcc.json")).collect()} == {
        ("5411", "Grocery"), ("5812", "Eating, places")}
    (tmp_path / "zip.csv").write_text("zip_code,latitude,longitude,city\n00501,40.8,-73.0,Holtsville\n99950,55.8,-132.9,Ketchikan\n")
    got = {r.zip: r for r in read_zip_centroids(spark, str(tmp_path / "zip.csv")).collect()}
    assert set(got) == {"00501", "99950"} and got["00501"].latitude == 40.8 and got["00501"].city == "Holtsville"


def test_snapshots(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    day = datetime(2024, 1, 1)
    scores = lambda *values: spark.createDataFrame([(v,) for v in values], "risk_score int")
    assert [table.publish(scores(1, None, None), day), table.publish(scores(1, 2), day + timedelta(days=1)), table.publish(scores(5), day + timedelta(days=20))] == [0, 1, 2]
    assert table.read().first().risk_score == 5
    assert table.read(version=0).count() == 3
    assert table.read(timestamp=day + timedelta(days=3)).count() == 2
    with pytest.raises(ValueError):
        table.read(timestamp=day - timedelta(days=1))
    assert [tuple(r) for r in table.audit([0, 1], "risk_score").collect()] == [(0, 2), (1, 0)]
    later = day + timedelta(days=21)
    # version 1 was the table until a day before
    assert sorted(r.version for r in table.expired(later).collect()) == [0]
    assert table.remove_expired(later) == [0]
    assert table.read().count() == 1 and table.history().count() == 3
    for days in range(14, 22):  # every moment within the retention stays readable
        assert table.read(timestamp=day + timedelta(days=days)).count() == (1 if days >= 20 else 2)
    with pytest.raises(ValueError, match="removed"):
        table.read(version=0)
    # much later the newest version is still not expired
    assert 2 not in [r.version for r in table.expired(day + timedelta(days=999)).collect()]


def test_layouts(spark, tmp_path):
    df = spark.range(1000).select(
        F.col("id"), (F.col("id") % 7).alias("client_id"), (F.col("id") % 14).alias("card_id"),
        F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 60 as int))").alias("date"),
    )
    write_by_month(df, str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    assert back.count() == 1000 and {"txn_year", "txn_month"} <= set(back.columns)
    plan = back.filter("txn_month = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(txn_month" in plan
    write_clustered(df, str(tmp_path / "c"), files=4)
    per_file = spark.read.parquet(str(tmp_path / "c")).groupBy(F.input_file_name().alias("f")).agg(F.min("client_id").alias("a"), F.max("client_id").alias("b")).orderBy("a").collect()
    assert all(left.b <= right.a for left, right in zip(per_file, per_file[1:]))
    commented = with_column_comments(df, {"date": "when"})
    commented.write.parquet(str(tmp_path / "k"))
    assert spark.read.parquet(str(tmp_path / "k")).schema["date"].metadata["comment"] == "when"


def test_ingest_runs_few_jobs_for_many_files(spark, tmp_path):
    (tmp_path / "few").mkdir()
    (tmp_path / "many").mkdir()
    tracker = spark.sparkContext.statusTracker()

    def newest():
        spark.range(1).count()
        return max(tracker.getJobIdsForGroup("mark") or [0])

    spark.sparkContext.setJobGroup("mark", "mark")
    start = newest()
    for folder, files in (("few", 2), ("many", 150)):
        for k in range(files):
            put(tmp_path / folder / "in", f"{k}.csv", f"id,date,amount,points\n{k},2024-01-01 10:00:00,$5.00,3\n")
    taken = []
    for folder, files in (("few", 2), ("many", 150)):
        base = tmp_path / folder
        rows = ingest_csv_folder(spark, str(base / "in"), str(base / "raw"), str(base / "state"), "many", HINTS)
        assert rows.count() == files
        spark.sparkContext.setJobGroup("mark", "mark")
        end = newest()
        taken.append(end - start)
        start = end
    assert taken[1] <= taken[0] + 5
