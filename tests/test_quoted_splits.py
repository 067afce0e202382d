"""Quoted line breaks in one file of very many small splits."""
import csv
import random

from pyspark.sql import functions as F

from colweave.session import TASK_BYTES, few_tasks
from colweave.sources import discovery, quoted


def _small_splits(spark, size, run):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        return run()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_small_splits_share_tasks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(4000)))

    def run():
        source = spark.read.text(str(tmp_path / "a.txt"))
        some = few_tasks(source.select(F.col("_metadata.file_block_start").alias("block"), "value"), source)
        assert source.rdd.getNumPartitions() > 300 and some.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
        # Every split is still there, its lines in order and together.
        got = [r["block"] for part in some.rdd.glom().collect() for r in part]
        assert len(got) == 4000 and len(set(got)) > 300
        assert sum(a != b for a, b in zip(got, got[1:])) == len(set(got)) - 1
    _small_splits(spark, 100, run)
    assert TASK_BYTES < 128 * 1024 * 1024


def test_records_over_any_number_of_splits(spark, tmp_path):
    """Records within a split, over two and over many, blank lines in and between them, an open quote at the end."""
    draw = random.Random(4)
    texts = ["", "plain", 'say "x", twice', "a\n\nb", "\n", '\n"', ",\n,", "long " * 60 + "\n" + "more\n" * 40, ' "', "é\r\n√"]
    wanted = {}
    for name in ("one.csv", "two.csv"):
        table = [[str(i), draw.choice(texts), draw.choice(texts), "end"] for i in range(300)]
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
            writer.writerow(["n", "a", "b", "c"])
            for i, row in enumerate(table):
                writer.writerow(row)
                if i % 7 == 0:
                    out.write("\n" * (i % 3))
            out.write('300,"open\n\nuntil\n\nthe end\n')
        wanted[name] = [r[1:] for r in table]

    def run():
        records = quoted.read_records(spark, [str(tmp_path / n) for n in wanted], ",", F.col("_metadata.file_name"))
        rows = records.select("file", "number", F.from_csv("record", "n string, a string, b string, c string", {
            "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}).alias("r")).select("file", "number", "r.*").collect()
        for name, table in wanted.items():
            got = sorted((r for r in rows if r["file"] == name), key=lambda r: r["number"])
            assert [r["number"] for r in got] == list(range(2, 303)) and [r["n"] for r in got] == [str(i) for i in range(301)]
            assert [[r["a"] or "", r["b"] or "", r["c"]] for r in got[:-1]] == table
            assert got[-1]["a"].startswith("open\n\nuntil\n\nthe end")
        return len(rows)
    assert _small_splits(spark, 90, run) == _small_splits(spark, 4000, run) == 602


def test_few_pieces_are_brought_together(spark, tmp_path, monkeypatch):
    """Only the ends of splits are shuffled: at most two pieces of each."""
    body = "".join(f'{i},"first\n\nlast"\n' for i in range(2000))
    (tmp_path / "a.csv").write_text("n,v\n" + body)
    seen = []
    real = quoted.materialise

    def spy(df):
        out = real(df)
        seen.append((out.columns, out))
        return out
    monkeypatch.setattr(quoted, "materialise", spy)
    _small_splits(spark, 1000, lambda: quoted.read_records(spark, [str(tmp_path / "a.csv")], ",", F.col("_metadata.file_path")))
    splits = len(body) // 1000 + 1
    pieces, = [df for cols, df in seen if cols == ["file_no", "number", "block", "text"]]
    assert 0 < pieces.where("block IS NOT NULL").count() <= 2 * splits < 200 and pieces.where("block IS NULL").count() > 1900


def test_shapes_leave_every_cast_as_it_was(spark):
    whole = ["0", "12", "+7", "-3", "007", "2147483648", "-9223372036854775809", "12.0", "12.", "1e3", "\t5", "6\n", "1 2", "٣"]
    numbers = ["1.5", ".5", "-.5e-3", "5.", ".", "-", "1f", "2D", "0x1p3", "Infinity", "-inf", "+INF", "nan", "NaN", "+nan", "1,5", "\x7f8"]
    times = ["2024", "24", "123", "12345", "1234567", "12345678", "+2024", "-0044-03-15", "2024-1", "2024-01-02", "2024-1-2 3:4:5.6", "2024-01-02T03:04:05Z",
             "T12", "t1:2", "T12:30", "12:30", "12:30:15.5", "1:2:3+01:00", "2024-01-02 ", "2024.5", "2024/01/02", "now", "today", "epoch", "20240102",
             "12:30 UTC", "2024-01-02 03", "2024-01-02T", "T", "1T2", "2024Z", "12 :30"]
    flags = ["t", "True", "YES", "y", "1", "0", "no", "f", "FALSE", "n", " yes", "on", "true\n", "\ttrue"]
    df = spark.createDataFrame([(v,) for v in [*whole, *numbers, *times, *flags, "", " ", "text", None]], "v string")
    for kind in ("int", "bigint", "double", "date", "timestamp", "boolean"):
        bad = df.select("v", quoted.cast_if_shaped(F.col("v"), kind).alias("a"), F.col("v").try_cast(kind).alias("b")).where("NOT a <=> b").collect()
        assert not bad, (kind, bad)
