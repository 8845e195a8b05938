import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidefold.sources import files, tsf

GOOD = """# comment
@relation demo
@frequency daily
@horizon 7
@missing true
@equallength false
@attribute series_name string
@attribute weight numeric
@attribute start date
@data
first:2:2020-01-01 00-00-00:1,2.5,?,4
:3:2020-01-02 00-00-00:?,5
"""


@pytest.fixture
def panel(tmp_path):
    def write(text, name="panel.tsf"):
        path = tmp_path / name
        path.write_text(text)
        return str(path)

    return write


def test_panel_file(spark, panel):
    path = panel(GOOD)
    got = tsf.read_panel(spark, path).orderBy("series_id", "pos").collect()
    assert [(r["series_id"], r["pos"], r["value"]) for r in got] == [
        ("first", 0, 1.0), ("first", 1, 2.5), ("first", 2, None), ("first", 3, 4.0), ("series_0001", 0, None), ("series_0001", 1, 5.0)
    ]
    assert {r["horizon"] for r in got} == {7}
    head = tsf.metadata(spark, path).first()
    assert head["frequency"] == "daily" and head["contains_missing"] is True and head["equal_length"] is False
    assert head["names"] == ["series_name", "weight", "start"]
    row = tsf.read_records(spark, path).filter("index = 0").select(
        F.to_json(tsf.typed_attributes(F.col("attributes"), F.col("kinds"))).alias("j"),
        F.variant_get(tsf.typed(F.col("attributes")["weight"], F.lit("numeric")), "$", "double").alias("w"),
    ).first()
    assert row["w"] == 2.0 and '"weight":2' in row["j"] and '"start":"2020-01-01T00:00:00"' in row["j"]


@pytest.mark.parametrize(
    "text,message",
    [
        ("@data\na:1,2\n", "no attributes"),
        ("@attribute id string\na:1,2\n", "no data tag"),
        ("@attribute id string\n@attribute x string\n@data\na:1,2\n", "wrong number of fields"),
        ("@attribute id string\n@data\na:?,?\n", "no value"),
        ("@attribute id\n@data\na:1\n", "invalid declaration"),
    ],
)
def test_bad_panel_files(spark, panel, text, message):
    with pytest.raises(PySparkException, match=message):
        tsf.read_records(spark, panel(text)).collect()


def test_horizon_order(spark):
    df = spark.createDataFrame([({"Horizon": "3"}, 7), ({"x": "1"}, 7), ({"x": "1"}, None)], "a map<string,string>, d int")
    got = df.coalesce(1).select(tsf.horizon(F.col("a"), F.col("d"), 5).alias("h"))
    assert [r["h"] for r in got.collect()] == [3, 7, 5]
    with pytest.raises(PySparkException, match="no valid forecast horizon"):
        df.select(tsf.horizon(F.col("a"), F.col("d"))).collect()


def test_region_file_contract(spark, tmp_path):
    good, bad, renamed = tmp_path / "good.csv", tmp_path / "bad.csv", tmp_path / "renamed.csv"
    good.write_text("Datetime,AEP_MW\n2012-01-01 00:00:00,5\n2012-01-01 00:00:00,7\n")
    bad.write_text("Datetime,AEP_MW\n2012-01-01 00:00:00,-5\n")
    renamed.write_text("Datetime,OTHER\n2012-01-01 00:00:00,5\n")
    assert files.region_csv(spark, str(good), "aep", "AEP_MW").count() == 2
    with pytest.raises(PySparkException, match="positive"):
        files.region_csv(spark, str(bad), "aep", "AEP_MW").collect()
    with pytest.raises(Exception, match="header"):
        files.region_csv(spark, str(renamed), "aep", "AEP_MW").collect()


def test_zone_file_pattern(spark, tmp_path):
    path = tmp_path / "zones.csv"
    path.write_text("DateTime,Zone 1 Power,Zone 2  Power\n1/1/2017 0:00,10,20\n12/31/2017 23:50,11,21\n")
    got = files.zones_csv(spark, str(path), {"Zone 1 Power": "zone_1", "Zone 2  Power": "zone_2"}).toPandas()
    assert len(got) == 4 and str(got["ts"].max()) == "2017-12-31 23:50:00"


def test_existing_output_is_refused(spark, tmp_path):
    df = spark.range(3)
    files.write_new(df, str(tmp_path / "out"))
    with pytest.raises(PySparkException):
        files.write_new(df, str(tmp_path / "out"))


def test_hash_manifest_states(spark, tmp_path):
    import hashlib

    (tmp_path / "a.txt").write_text("a")
    (tmp_path / "b.txt").write_text("b")
    manifest = spark.createDataFrame(
        [("a.txt", hashlib.sha256(b"a").hexdigest()), ("b.txt", "0"), ("c.txt", "0")], "name string, sha256 string"
    )
    got = {r["name"]: r["state"] for r in files.verify_hashes(files.file_hashes(spark, str(tmp_path)), manifest).collect()}
    assert got == {"a.txt": "same", "b.txt": "changed", "c.txt": "missing"}


def test_models_round_trip(spark, tmp_path):
    models = spark.createDataFrame([("s", 2, 1, [0.1, 0.2])], "series_id string, lag int, k int, coefficients array<double>")
    rules = spark.createDataFrame([("s", 2, 1, 1, [0.0, 0.0])], "series_id string, lag int, k int, rule_count int, centers array<double>")
    files.write_models(models, rules, str(tmp_path / "m"))
    got = files.read_models(spark, str(tmp_path / "m")).first()
    assert got["coefficients"] == [0.1, 0.2] and got["centers"] == [0.0, 0.0]


def test_wide_panel_contract(spark, tmp_path):
    day = 86_400

    def write(name, days, values):
        rows = [(f"2020-01-{d:02d}", float(v), 1.0) for d, v in zip(days, values)]
        df = spark.createDataFrame(rows, "t string, x double, y double").select(F.col("t").cast("timestamp_ntz").alias("timestamp"), "x", "y")
        df.write.parquet(str(tmp_path / name))
        return str(tmp_path / name)

    good = write("good", (1, 2, 3), (1, 2, 3))
    assert files.read_wide_panel(spark, good, ["x", "y"], 3, day).count() == 6
    with pytest.raises(ValueError, match="columns"):
        files.read_wide_panel(spark, good, ["y", "x"], 3, day)
    with pytest.raises(PySparkException, match="expected 4 rows"):
        files.read_wide_panel(spark, good, ["x", "y"], 4, day).collect()
    with pytest.raises(PySparkException, match="uniform time step"):
        files.read_wide_panel(spark, write("gap", (1, 2, 4), (1, 2, 3)), ["x", "y"], 3, day).collect()
    with pytest.raises(PySparkException, match="positive"):
        files.read_wide_panel(spark, write("negative", (1, 2, 3), (1, -2, 3)), ["x", "y"], 3, day).collect()


def test_attributes_are_checked_against_their_types(spark, panel):
    """Numeric ids are written plainly; wrong values, unknown types and files without a data line fail."""
    numeric = GOOD.replace("@attribute series_name string", "@attribute series_name numeric").replace("first:2:", "007:2.50:")
    rows = tsf.read_panel(spark, panel(numeric, "a.tsf")).select("series_id", F.col("attributes")["weight"].alias("weight")).distinct().collect()
    assert sorted(r["series_id"] for r in rows) == ["7", "series_0001"]
    assert {r["weight"] for r in rows} == {"2.5", "3"}
    for name, text, message in (
        ("b", GOOD.replace("first:2:", "first:two:"), "attribute is not numeric"),
        ("c", GOOD.replace("2020-01-01 00-00-00", "yesterday"), "attribute is not date"),
        ("d", GOOD.replace("weight numeric", "weight foo"), "unknown attribute type"),
        ("e", GOOD.split("first:")[0], "no data line"),
    ):
        with pytest.raises(PySparkException, match=message):
            tsf.read_panel(spark, panel(text, f"{name}.tsf")).collect()


def test_lag_rows_are_read_under_their_contract(spark, tmp_path):
    from tidefold.operators.compare import paired

    schema = "series_id string, step long, role string, features array<double>, context_imputed_count long, target_observed boolean"
    rows = [("a", k, "prior" if k < 6 else "test", [1.0, 2.0], 0, True) for k in range(2, 9)]
    path = str(tmp_path / "lags")
    files.write_lagged(spark.createDataFrame(rows, schema), path, 2)
    assert files.read_lagged(spark, path, 2).count() == 7 and files.read_lagged(spark, path, 2, "test").count() == 3
    assert files.read_lagged(spark, path, 3).count() == 0
    bad = str(tmp_path / "bad")
    files.write_lagged(spark.createDataFrame(rows + rows[:1], schema), bad, 2)
    with pytest.raises(PySparkException, match="break their contract"):
        files.read_lagged(spark, bad, 2).collect()

    left = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, v double")
    right = spark.createDataFrame([("x", 0.5)], "k string, v double")
    assert paired(left, right, ["k"], ["v"], 1).count() == 1
    with pytest.raises(PySparkException, match="expected 2 rows, found 1"):
        paired(left, right, ["k"], ["v"], 2).collect()


def test_bad_cells_are_marked_or_fail(spark, tmp_path):
    path = str(tmp_path / "r")
    spark.createDataFrame([("2020-01-01 00:00:00", 1.0), ("2020-01-01 01:00:00", -2.0), ("2020-01-01 02:00:00", None), ("2020-01-01 03:00:00", float("nan"))], "Datetime string, L double").write.option("header", "true").csv(path)
    got = {str(r["ts"])[11:13]: r["problem"] for r in files.region_csv(spark, path, "r", "L", on_bad="mark").collect()}
    assert got == {"00": None, "01": "not positive", "02": "missing", "03": "not finite"}
    with pytest.raises(Exception, match="finite and positive"):
        files.region_csv(spark, path, "r", "L").collect()


def test_hashes_are_streamed(spark, tmp_path, monkeypatch):
    import hashlib

    bodies = {"a.bin": b"\n", "b.bin": b"x" * (3 * files.PART + 7), "c.bin": b"one"}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    found = files.file_hashes(spark, str(tmp_path), "*.bin")
    assert {r["name"]: (r["bytes"], r["sha256"]) for r in found.collect()} == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in bodies.items()}
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()


def test_period_holds_all_rows(spark):
    from datetime import datetime

    from tidefold.sources import panels

    rows = spark.createDataFrame([("a", datetime(2019, 12, 31, 23, 59)), ("b", datetime(2021, 1, 1)), ("b", None)], "series_id string, ts timestamp_ntz")
    p = panels.observed_period(rows, panels.DAY, 7)
    assert (p.start, p.end) == (datetime(2019, 12, 31), datetime(2021, 1, 2))
    got = {r["series_id"]: (r["rows"], r["rows_before"], r["rows_behind"], r["rows_without_time"]) for r in panels.outside(rows, panels.Period(datetime(2020, 1, 1), datetime(2021, 1, 1), panels.DAY, 7)).collect()}
    assert got == {"a": (1, 1, 0, 0), "b": (2, 0, 1, 1)}


def test_a_table_of_part_files_is_one_manifest_entry(spark, tmp_path):
    """Part files of one name in two tables stay apart; a changed part changes its table."""
    for table in ("documents", "labels"):
        (tmp_path / f"{table}.parquet").mkdir()
        for part in range(2):
            (tmp_path / f"{table}.parquet" / f"part-{part}.parquet").write_bytes(f"{table} {part}".encode())
    (tmp_path / "nation.parquet").write_bytes(b"one file")
    found = files.file_hashes(spark, str(tmp_path), "*.parquet")
    assert {r["name"] for r in found.collect()} == {f"{t}.parquet/part-{p}.parquet" for t in ("documents", "labels") for p in range(2)} | {"nation.parquet"}
    kept = found.filter("name != 'nation.parquet'").withColumn("sha256", F.when(F.col("name") == "labels.parquet/part-1.parquet", "0").otherwise(F.col("sha256")))
    gone = spark.createDataFrame([("absent.parquet/part-0.parquet", "0"), ("absent.parquet/part-1.parquet", "0")], "name string, sha256 string")
    got = files.entry_states(files.verify_hashes(found, kept.select("name", "sha256").unionByName(gone)))
    assert {r["name"]: r["state"] for r in got.collect()} == {
        "documents.parquet": "same", "labels.parquet": "changed", "nation.parquet": "unexpected", "absent.parquet": "missing"}
