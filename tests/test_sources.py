from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from panelytics.operators import clean_panel, join_panels
from panelytics.sources import export, find_csv, read_csv_panel, register, run_sql, show_sql, write_panel
from panelytics.sources import workspace as ws
from panelytics.sources.csv_panels import cell_count


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_find_by_keyword_in_any_case_and_sub_folder(spark, tmp_path):
    _write(tmp_path / "in put" / "Covid_DEATHS.csv", "a\n1\n")
    _write(tmp_path / "deaths.txt", "a\n1\n")
    _write(tmp_path / "vacc.csv", "a\n1\n")
    (found,) = find_csv(spark, str(tmp_path), "death")
    assert found.endswith("in put/Covid_DEATHS.csv")


def test_missing_file_is_named_in_the_error(spark, tmp_path):
    _write(tmp_path / "vacc.csv", "a\n1\n")
    with pytest.raises(FileNotFoundError, match="'death'"):
        read_csv_panel(spark, str(tmp_path), "death")


def test_cells_stay_text_and_quotes_are_doubled(spark, tmp_path):
    _write(tmp_path / "x y" / "deaths.csv", 'iso_code,location,n\nA,"Bonaire, ""BES"" \\ Saba",007\nB,,NA\n')
    rows = read_csv_panel(spark, str(tmp_path), "DEATH").collect()
    assert sorted(map(tuple, rows)) == [("A", 'Bonaire, "BES" \\ Saba', "007"), ("B", None, "NA")]


def test_one_match_unless_all_or_the_first_are_asked_for(spark, tmp_path):
    _write(tmp_path / "deaths_1.csv", "a,b\n1,2\n")
    _write(tmp_path / "deaths_2.csv", "a,b\n3,4\n")
    with pytest.raises(ValueError, match="deaths_1.csv.*deaths_2.csv"):
        read_csv_panel(spark, str(tmp_path), "death")
    assert read_csv_panel(spark, str(tmp_path), "death", all_matches=True).count() == 2
    assert read_csv_panel(spark, str(tmp_path), "death", first_only=True).collect() == [("1", "2")]


def test_files_with_other_headers_are_an_error(spark, tmp_path):
    _write(tmp_path / "deaths_1.csv", "a,b\n1,2\n")
    _write(tmp_path / "deaths_2.csv", "b,a\n3,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv_panel(spark, str(tmp_path), "death", all_matches=True).collect()


def test_rows_with_surplus_cells_are_refused(spark, tmp_path):
    _write(tmp_path / "deaths.csv", 'a,b\n1,"2,x"\n3,4,5\n')
    with pytest.raises(Exception, match="more than 2 cells: 3,4,5"):
        read_csv_panel(spark, str(tmp_path), "death").select("a").collect()


def test_a_folder_of_parts_is_one_match(spark, tmp_path):
    export(spark.range(10).toDF("a").repartition(3), str(tmp_path / "deaths.csv"), "csv")
    assert read_csv_panel(spark, str(tmp_path), "death").count() == 10


def test_short_rows_are_padded_with_missing(spark, tmp_path):
    _write(tmp_path / "deaths.csv", "a,b\n1\n")
    assert read_csv_panel(spark, str(tmp_path), "death").collect() == [("1", None)]


def test_line_breaks_inside_quotes_when_asked_for(spark, tmp_path):
    _write(tmp_path / "deaths.csv", 'a,b\n"x\ny",2\n')
    assert read_csv_panel(spark, str(tmp_path), "death", multi_line=True).collect() == [("x\ny", "2")]


def test_view_is_replaced(spark):
    register(spark.range(3).toDF("x"), "replaced_view")
    register(spark.range(5).toDF("x"), "replaced_view")
    assert run_sql(spark, "SELECT count(*) AS n FROM replaced_view;\n").collect() == [(5,)]


def test_show_previews_but_returns_everything(spark, capsys):
    register(spark.range(40).toDF("x"), "forty")
    result = show_sql(spark, "Forty rows", "SELECT x FROM forty ORDER BY x;", rows=3)
    printed = capsys.readouterr().out
    assert result.count() == 40
    assert "Forty rows" in printed and "|2 " in printed and "|3 " not in printed


def test_show_stores_once_or_prints_no_rows(spark, capsys, tmp_path):
    register(spark.range(40).toDF("x"), "forty")
    result = show_sql(spark, "Stored", "SELECT x FROM forty", rows=2, store=str(tmp_path / "forty"))
    assert result.count() == 40 and result.inputFiles()
    show_sql(spark, "Title", "SELECT x FROM forty", rows=0)
    printed = capsys.readouterr().out
    assert "Title" in printed and printed.count("+") == 6


def _panel(spark, name):
    rows = [(f"I{i % 7}", dt.date(2021, 1, 1 + i // 7), float(i)) for i in range(140)]
    return spark.createDataFrame(rows, f"iso_code string, date date, {name} double")


def test_bucketed_tables_join_without_a_shuffle(spark, plan_of):
    left = register(_panel(spark, "a"), "bucketed_a", persistent=True, buckets=4)
    right = register(_panel(spark, "b"), "bucketed_b", persistent=True, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = join_panels(left, right)
        assert "Exchange" not in plan_of(joined)
        assert joined.count() == 140
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_persistent_table_is_replaced(spark):
    register(_panel(spark, "a"), "kept_table", persistent=True)
    assert register(_panel(spark, "b"), "kept_table", persistent=True).columns == ["iso_code", "date", "b"]


@pytest.mark.parametrize("cluster_by", [(), ("location", "date")])
def test_stored_panel_keeps_rows_and_types(spark, tmp_path, cluster_by):
    panel = _panel(spark, "a").withColumnRenamed("iso_code", "location")
    stored = write_panel(panel, str(tmp_path / "p"), cluster_by)
    assert stored.schema == panel.schema
    assert sorted(stored.collect()) == sorted(panel.collect())


@pytest.mark.parametrize("single_file", [False, True])
def test_csv_export_reads_back(spark, tmp_path, single_file):
    panel = _panel(spark, "new_cases")
    export(panel, str(tmp_path / "deaths.csv"), "csv", single_file)
    back = clean_panel(read_csv_panel(spark, str(tmp_path), "death"))
    assert sorted(back.collect()) == sorted(panel.collect())


def test_unknown_format_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="xlsx"):
        export(spark.range(1), str(tmp_path / "x"), "xlsx")


class _Conf:
    def __init__(self, **settings):
        self.conf = self
        self.settings = {key.replace("_", "."): value for key, value in settings.items()}

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_workspace_is_the_shared_folder_where_one_is_named(monkeypatch):
    removed = []
    monkeypatch.setattr(ws, "_remove_at_end", lambda _, folder: removed.append(folder))
    path = ws.workspace(_Conf(spark_checkpoint_dir="hdfs://shared/cp/", spark_master="yarn"))
    assert path.startswith("hdfs://shared/cp/panelytics-") and removed == [path]


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[2,1,1024]"])
def test_no_machine_local_workspace_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ws.workspace(_Conf(spark_master=master, spark_app_id="a"))


@pytest.mark.parametrize("multi_line", [False, True])
def test_byte_order_mark_and_windows_line_ends(spark, tmp_path, multi_line):
    (tmp_path / "deaths.csv").write_bytes("\ufeffiso_code,date,n\r\nX,1/2/2021,5\r\n\r\nY,,\r\n".encode())
    cleaned = clean_panel(read_csv_panel(spark, str(tmp_path), "death", multi_line=multi_line))
    assert cleaned.columns == ["iso_code", "date", "n"]
    assert sorted(cleaned.collect()) == [("X", dt.date(2021, 1, 2), 5.0), ("Y", None, None)]


def test_panels_are_built_once_unless_refreshed(spark, sf_dir, panels):
    from panelytics.sources import star_schema

    files = lambda loaded: loaded.outcomes.inputFiles()
    assert files(star_schema.load_panels(spark, sf_dir)) == files(panels)
    assert files(star_schema.load_panels(spark, sf_dir, refresh=True)) != files(panels)


@pytest.mark.parametrize(
    "row, cells",
    [
        ("a,b", 2),
        ("", 1),
        (",", 2),
        ('"a,b",c', 2),
        ('"a ""quoted"", b",c', 2),
        ('5" pipe,6" pipe', 2),
        ('"",""', 2),
        ('"a,b', 1),
        ('x,"a,b,c",,"d"', 4),
        ('"""",","', 2),
    ],
)
def test_cells_of_a_row_are_counted(spark, row, cells):
    assert spark.createDataFrame([(row,)], "row string").select(cell_count(F.col("row"))).first()[0] == cells


@pytest.mark.parametrize("surplus", [False, True])
def test_long_rows_of_quotes_and_commas(spark, tmp_path, surplus):
    """A megabyte with 50,000 quotes in one cell: padded where a cell is missing, refused where one is too many."""
    cell = '"' + 'x,y""z,"" and more text' * 25_000 + '"'
    (tmp_path / "a_death.csv").write_text("iso_code,date,n\n" + f"A,{cell}" + (",1,2" if surplus else "") + "\nB,2020-01-01,5\n")
    started = time.monotonic()
    read = read_csv_panel(spark, str(tmp_path), "death")
    if surplus:
        with pytest.raises(Exception, match="more than 3 cells"):
            read.collect()
    else:
        rows = {r["iso_code"]: r for r in read.collect()}
        assert rows["A"]["n"] is None and len(rows["A"]["date"]) == 25_000 * 21 and rows["B"]["n"] == "5"
    assert time.monotonic() - started < 20


def test_quotes_inside_plain_cells_hide_no_surplus(spark, tmp_path):
    (tmp_path / "a_death.csv").write_text('a,b\n5" pipe,6" pipe,7\n')
    with pytest.raises(Exception, match="more than 2 cells"):
        read_csv_panel(spark, str(tmp_path), "death").collect()


def test_checked_files_are_read_by_column(spark, tmp_path, plan_of):
    (tmp_path / "a_death.csv").write_text("a,b,c\n1,2,3\n4\n")
    plan = plan_of(read_csv_panel(spark, str(tmp_path), "death", checked=False).select("b"))
    assert "ReadSchema: struct<b:string>" in plan
    assert sorted(map(str, read_csv_panel(spark, str(tmp_path), "death", checked=False).select("b").collect())) == [
        "Row(b='2')",
        "Row(b=None)",
    ]
