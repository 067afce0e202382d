import csv
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from colweave.operators import graphs
from colweave.sources import artefacts, discovery, quoted


def write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


@pytest.fixture
def folder(tmp_path):
    write(tmp_path / "Mill A", "one.csv", "timestamp,value\n2031-03-12,2.5\n2031-03-11,1.5\n")
    write(tmp_path / "Mill A" / "deep", "two.csv", "value,timestamp\n3.5,2031-03-13\n")
    write(tmp_path / "Mill A", "empty.csv", "timestamp,value\n")
    write(tmp_path / "Mill A", "notes.txt", "not data")
    (tmp_path / "Quay 7").mkdir()
    pd.DataFrame({"timestamp": ["2031-03-11"], "depth": [20.0]}).to_parquet(tmp_path / "Quay 7" / "b.parquet")
    write(tmp_path / "Drift", "a.csv", "time,flow\n2031-03-11,1.0\n")
    write(tmp_path / "Drift", "b.csv", "time,level\n2031-03-11,1.0\n")
    write(tmp_path / "Hollow", "h.tsv", "time\tv\n")
    write(tmp_path / "Tabs", "t.tsv", "timestamp\tvalue\n2026-01-01\t7\n")
    write(tmp_path, "stray.csv", "x\n1\n")
    return tmp_path


def test_discovery(spark, folder, rows):
    found = discovery.discover_stations(spark, str(folder))
    assert rows(found, "station", "file_name") == [
        ("Drift", "a.csv"), ("Drift", "b.csv"), ("Hollow", "h.tsv"), ("Mill A", "empty.csv"),
        ("Mill A", "one.csv"), ("Mill A", "two.csv"), ("Quay 7", "b.parquet"), ("Tabs", "t.tsv")]


def test_root_station(spark, tmp_path, rows):
    write(tmp_path, "x.csv", "a\n1\n")
    assert rows(discovery.discover_stations(spark, str(tmp_path)), "station", "file_name") == [("root_station", "x.csv")]


def test_loading(spark, folder, rows):
    loaded = discovery.load_stations(spark, str(folder))
    assert rows(loaded.failures, "station", "reason") == [
        ("Drift", "The files of the station differ in their columns."), ("Hollow", "No file has a row.")]
    assert ("Mill A", "empty.csv", 0, 2) in rows(loaded.inventory, "station", "file_name", "rows", "cols")
    tables = {tuple(sorted(cols)): df for cols, df in loaded.tables}
    # A tab file with the same columns shares the table, although it was read on its own.
    values = rows(tables[("timestamp", "value")], "station", "value")
    assert values == [("Mill A", 1.5), ("Mill A", 2.5), ("Mill A", 3.5), ("Tabs", 7.0)]
    assert rows(tables[("depth", "timestamp")], "station", "depth") == [("Quay 7", 20.0)]


def test_quoted_line_breaks(spark, tmp_path, rows):
    write(tmp_path / "Mill", "a.csv", 'note,v\n"two\nlines",1\n"say ""hi""",2\n')
    write(tmp_path / "Mill", "b.csv", "note,v\nplain,3\n")
    write(tmp_path / "Sheets", "s.xlsx", "no table")
    loaded = discovery.load_stations(spark, str(tmp_path))
    assert rows(loaded.failures, "station", "reason") == [("Sheets", "No file of a known kind.")]
    (_, df), = loaded.tables
    assert rows(df, "note", "v") == [("plain", 3), ('say "hi"', 2), ("two\nlines", 1)]


def test_quotes_at_the_end_of_a_line():
    lines = ['a,b', '"a,b', 'a"b,c', 'a,"b""', 'a,"b"",c"', '"a"x,"', 'a",b', '', '"', '""', '"""', 'a,b"', '"a""b"," c']
    for line in lines:
        for inside in (False, True):
            state = inside
            fresh = not inside
            k = 0
            while k < len(line):  # letter by letter
                if state:
                    if line[k] == '"':
                        if line[k + 1:k + 2] == '"':
                            k += 1
                        else:
                            state = False
                elif line[k] == '"' and fresh:
                    state = True
                fresh = not state and line[k] == ","
                k += 1
            assert quoted.ends_outside(line, inside, ",") == (not state), (line, inside)


def test_records_over_lines_in_many_splits(spark, tmp_path):
    """One file, splits of a few hundred bytes: every record comes out as the csv module reads it."""
    rng = random.Random(5)
    values = ["plain", "two\nlines", 'say "hi"', "", 'a "" b', "x, y", 'inch 5" pipe', "\n\n", "tail\n", '"', "dé\nf" * 40]
    table = [[str(i), rng.choice(values), rng.choice(values), str(rng.random())] for i in range(900)]
    path = tmp_path / "one.csv"
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(["n", "file", "number", "v"])
        writer.writerows(table[:400])
        out.write("\n")  # a blank line is no record
        out.write('900,inch 5" pipe,x,0.5\n')  # a quote within a bare value is plain
        writer.writerows(table[400:])
    want = [r for r in csv.reader(open(path, newline="", encoding="utf-8")) if r][1:]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = discovery.read_files(spark, "csv", [str(path)], True, ["n", "file", "number", "v"])
        assert spark.read.text(str(path), lineSep="\n").rdd.getNumPartitions() > 50
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = df.orderBy("row_id.pos").select("n", "file", "number", "v").collect()
    assert [[str(r["n"]), r["file"] or "", r["number"] or "", r["v"]] for r in got] == [[*r[:3], float(r[3])] for r in want]
    assert df.schema["n"].dataType.simpleString() == "int" and df.schema["v"].dataType.simpleString() == "double"


def test_windows_line_ends_and_an_open_quote(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_bytes(b'a,b\r\n1,"x\r\ny"\r\n2,z\r\n3,"never\r\nclosed')
    got = discovery.read_files(spark, "csv", [str(path)], True, ["a", "b"]).orderBy("row_id.pos").select("a", "b").collect()
    assert [(r["a"], r["b"].replace("\r\n", "\n")) for r in got] == [(1, "x\ny"), (2, "z"), (3, "never\nclosed")]


def test_strict_loading(spark, folder):
    with pytest.raises(discovery.SchemaDrift):
        discovery.load_stations(spark, str(folder), strict=True)


def test_folder_without_data(spark, tmp_path):
    write(tmp_path, "notes.txt", "not data")
    with pytest.raises(discovery.EmptyStation):
        discovery.load_stations(spark, str(tmp_path))


def test_reserved_names(spark, tmp_path):
    write(tmp_path, "x.csv", "station,v\nq,1\n")
    (cols, df), = discovery.load_stations(spark, str(tmp_path)).tables
    assert sorted(cols) == ["station_", "v"]
    assert df.first()["station"] == "root_station"


def test_time_order(spark, rows):
    df = spark.createDataFrame([
        ("a", 1, "2031-03-12", 1.0), ("a", 2, "2031-03-11", 2.0), ("b", 1, "2031-03-11", 1.0),
        ("b", 2, "2031-03-12", 2.0), ("b", 3, "2031-03-13", 2.0), ("b", 4, "2031-03-14", 2.0),
        ("b", 5, "no date", 2.0)], "station string, row_id long, time string, v double")
    dated, invalid = discovery.in_time_order(df, ["time", "v"])
    assert rows(invalid, "station", "reason") == [("b", "Some values are no times in column 'time'.")]
    first = dated.where("station = 'a'").orderBy("_order_ts").first()
    assert first["row_id"] == 2


def test_adjacency_round_trip(spark, tmp_path, rows):
    path = tmp_path / "m.csv"
    path.write_text(",a,b,c\na,0,0.5,\nb,0.3,0,-0.2\nd,0,0,0.1\n")
    cells = artefacts.read_adjacency(spark, str(path), "s", "weighted")
    assert cells.count() == 16
    assert [r[0] for r in cells.select("source").distinct().orderBy("source").collect()] == list("abcd")
    edges = graphs.graph_from_adjacency(cells)
    got = {(r["source"], r["target"]): r["weight"] for r in edges.collect()}
    assert got == {("a", "b"): 0.4, ("b", "c"): -0.2, ("d", "c"): 0.1}
    top = graphs.graph_from_adjacency(cells.withColumn("graph_type", F.lit("top_k")))
    assert {(r["source"], r["target"]) for r in top.collect()} == {("a", "b"), ("b", "a"), ("b", "c"), ("d", "c")}


def test_adjacency_rejects_text(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text(",a,b\na,0,oops\nb,1,0\n")
    with pytest.raises(Exception, match=r"Non-numeric value 'oops' found at cell \[a, b\]"):
        artefacts.read_adjacency(spark, str(path), "s", "weighted").collect()


def test_feature_scan(spark, tmp_path):
    df = spark.createDataFrame([("s", "t", 1.0, 2.0)], "station string, time string, value double, x double")
    artefacts.write_table(df, str(tmp_path / "cleaned"), "csv")
    got = artefacts.read_features(spark, str(tmp_path / "scaled"), str(tmp_path / "cleaned"), "csv")
    assert sorted(got.columns) == ["station", "x"]


def test_embedding_scans(spark, tmp_path, rows):
    df = spark.createDataFrame([("s", "weighted_GAT", "a", [1.0, 2.0])],
                               "station string, run string, node string, embedding array<double>")
    artefacts.write_embeddings(df, str(tmp_path / "e"))
    assert artefacts.read_embeddings(spark, str(tmp_path / "e")).first() == df.first()
    write(tmp_path / "saved", "top_k_GAT_embeddings.csv", ",0,1\na,0.5,1\nb,2,-3\n")
    write(tmp_path / "saved", "other.csv", "x\n1\n")
    got = artefacts.read_embedding_csvs(spark, str(tmp_path / "saved"), "s").orderBy("node").collect()
    assert [(r["run"], r["node"], r["embedding"]) for r in got] == [
        ("top_k_GAT", "a", [0.5, 1.0]), ("top_k_GAT", "b", [2.0, -3.0])]


def test_long_header_and_doubled_quotes(spark, tmp_path):
    names = [f"column_with_a_long_name_{i}" for i in range(30_000)]
    (tmp_path / "Wide").mkdir()
    (tmp_path / "Wide" / "w.csv").write_text(",".join(names) + "\n")
    found = discovery.with_columns(discovery.discover_stations(spark, str(tmp_path))).first()
    assert list(found["columns"]) == names
    (tmp_path / "Quotes").mkdir()
    (tmp_path / "Quotes" / "q.csv").write_text('note,value\n"say ""hi"", now",1.5\n')
    got = discovery.read_files(spark, "csv", [str(tmp_path / "Quotes" / "q.csv")]).select("note", "value").first()
    assert tuple(got) == ('say "hi", now', 1.5)


def test_missing_words(spark, tmp_path, rows):
    path = tmp_path / "m.csv"
    path.write_text("v,note,empty\n1.5,NA,n/a\nNA,yes,NULL\n2,null,NA\n")
    got = discovery.read_files(spark, "csv", [str(path)]).select("v", "note", "empty")
    assert dict(got.dtypes) == {"v": "double", "note": "string", "empty": "string"}
    assert rows(got) == [(1.5, None, None), (2.0, None, None), (None, "yes", None)]


def test_one_layout_per_station(spark, rows):
    df = spark.createDataFrame(
        [("day", i, t, 1.0) for i, t in enumerate(["13/01/2024", "03/02/2024", "22/02/2024"])]
        + [("month", i, t, 1.0) for i, t in enumerate(["01/13/2024", "02/03/2024", "02/22/2024"])]
        + [("mixed", i, t, 1.0) for i, t in enumerate(["13/01/2024", "14/01/2024", "15/01/2024", "16/01/2024", "2024-01-17"])],
        "station string, row_id int, time string, v double")
    dated, invalid = discovery.in_time_order(df, ["time", "v"])
    got = rows(dated.selectExpr("station", "cast(cast(_order_ts AS date) AS string) day"))
    assert [d for s, d in got if s == "day"] == ["2024-01-13", "2024-02-03", "2024-02-22"]
    assert [d for s, d in got if s == "month"] == ["2024-01-13", "2024-02-03", "2024-02-22"]
    assert rows(invalid, "station") == [("mixed",)]
