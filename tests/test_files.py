"""Report files with odd encodings and malformed rows."""

from pyspark.sql import functions as F

from aerogrid.sources import files

HEAD = "datetime,report\n"
GOOD = "2024-01-05 00:20:00,METAR EGLL 050020Z 24015KT 4000 BR OVC004 M01/M03 Q0998 Métar\n"


def _folder(tmp_path, **content):
    folder = tmp_path / "EGLL"
    folder.mkdir()
    for name, data in content.items():
        (folder / f"{name}.csv").write_bytes(data)
    return str(tmp_path)


def test_each_file_is_read_in_its_own_encoding(spark, tmp_path):
    root = _folder(tmp_path, a=(HEAD + GOOD).encode(), b=(HEAD + GOOD).encode("latin-1"))
    read = files.read_observations(spark, root, ["EGLL"], "2024-01-01", "2024-01-31", "auto")
    assert {r["report"][-5:] for r in read.collect()} == {"Métar"} and read.count() == 2
    found = {r["path"][-5:]: r["encoding"] for r in files.files_by_encoding(spark, f"{root}/EGLL").collect()}
    assert found == {"a.csv": "UTF-8", "b.csv": "ISO-8859-1"}


def test_malformed_rows_are_kept_apart(spark, tmp_path):
    root = _folder(tmp_path, a=(HEAD + GOOD + "not a date,METAR\n" + GOOD).encode())
    assert files.read_observations(spark, root, ["EGLL"], "2024-01-01", "2024-01-31").count() == 2
    bad = files.malformed_rows(spark, f"{root}/EGLL").collect()
    assert [(r["source_file"], r["line"]) for r in bad] == [("a.csv", "not a date,METAR")]


def test_files_of_many_stations_name_them_in_a_column(spark, tmp_path):
    (tmp_path / "group=3").mkdir()
    line = "{},2024-01-05 00:20:00,METAR XXXX 050020Z 24015KT 4000 BR OVC004 M01/M03 Q0998\n"
    (tmp_path / "group=3" / "a.csv").write_text("station," + HEAD + line.format("EGLL") + line.format("LSZH") + "LOWW,no date,METAR\n")
    read = lambda stations: files.read_observations(spark, str(tmp_path), stations, "2024-01-01", "2024-01-31", layout="group=*")
    assert sorted((r["station"], r["wind_speed_kt"], r["source_file"]) for r in read(None).collect()) == [("EGLL", 15.0, "a.csv"), ("LSZH", 15.0, "a.csv")]
    assert [r["station"] for r in read(["LSZH"]).collect()] == ["LSZH"]


def test_report_files_do_not_grow_with_the_stations(spark, tmp_path):
    from aerogrid.plans import source_queries

    rows = spark.range(0, 900, 1, 2).selectExpr("CASE WHEN id > 0 THEN concat('S', id % 300) END AS station", "timestamp_ntz'2024-01-05' AS datetime", "'METAR' AS report")
    source_queries._in_groups(rows, f"{tmp_path}/out")
    read = files.read_observations(spark, f"{tmp_path}/out", None, "2024-01-01", "2024-01-31", layout="group=*")
    assert len(list(tmp_path.glob("out/*/*.csv"))) <= 2 * source_queries.GROUPS
    assert read.count() == 900 and read.select("station").distinct().count() == 301
