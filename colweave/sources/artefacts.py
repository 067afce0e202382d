"""Saved tables: adjacency matrices, feature tables, embeddings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colweave.operators import graphs
from colweave.session import materialise

# Columns of a saved feature table that are never features.
NON_FEATURES = ("time", "element", "value")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by_station: bool = True) -> None:
    """Replace a saved table; the commit protocol publishes it only when complete."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    (writer.partitionBy("station") if by_station else writer).save(path)


def write_report(df: DataFrame, path: str) -> None:
    """Nested reports as JSON, one object per row."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_adjacency(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Labelled N x N matrices as CSV, one folder per station and graph type.

    Columns are the labels of all stations; those of other stations stay empty.
    """
    labels = [r["node"] for r in nodes.groupBy("node").agg(F.min("idx").alias("at")).orderBy("at", "node").collect()]
    own = nodes.groupBy("station", "graph_type").agg(F.collect_set("node").alias("_own"))
    matrix = graphs.adjacency_matrix(nodes, edges, labels).join(own, ["station", "graph_type"])
    cells = matrix.withColumns({c: F.when(F.array_contains("_own", c), F.col(f"`{c}`")) for c in labels}).drop("_own")
    (cells.orderBy("station", "graph_type", "idx").drop("idx").write.mode("overwrite").option("header", "true")
     .partitionBy("station", "graph_type").csv(path))


def read_saved_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """The cells of all matrices below a folder written by :func:`write_adjacency`, in one scan."""
    raw = spark.read.csv(path, header=True)
    keys = ["station", "graph_type"]
    labels = [c for c in raw.columns if c not in ("source", *keys)]
    cells = raw.unpivot([*keys, "source"], [f"`{c}`" for c in labels], "target", "value").where("value is not null")
    place = F.array_position(F.array(*[F.lit(c) for c in labels]), F.col("target"))
    first = F.array_position(F.array(*[F.lit(c) for c in labels]), F.col("source"))
    return cells.select(*[F.col(k).cast("string").alias(k) for k in keys], "source", "target", first.alias("source_idx"), place.alias("target_idx"),
                        F.col("value").cast("double").alias("weight"))


def read_adjacency(spark: SparkSession, path: str, station: str, graph_type: str) -> DataFrame:
    """Cells of a saved N x N matrix whose first column holds the row labels.

    Empty cells are 0; labels that occur only as a row or only as a column are
    completed with 0; text in a cell is an error naming the cell.
    """
    raw = spark.read.csv(path, header=True)
    label, columns = raw.columns[0], raw.columns[1:]
    # N rows of N labels: as many as the table had columns.
    rows = materialise(raw.select(
        F.col(f"`{label}`").alias("source"), F.monotonically_increasing_id().alias("_at"),
        *[F.col(f"`{c}`") for c in columns]))
    text = F.trim("value")
    number = F.expr("try_cast(trim(value) as double)")
    cells = rows.unpivot(["source"], [f"`{c}`" for c in columns], "target", "value").select(
        "source", "target",
        F.when(F.col("value").isNull() | (text == ""), 0.0)
        .when(number.isNull(), F.raise_error(F.concat(
            F.lit("Non-numeric value '"), "value", F.lit("' found at cell ["), "source", F.lit(", "),
            "target", F.lit(f"] in {path}"))).cast("double"))
        .when(F.isnan(number), 0.0).otherwise(number).alias("weight"))
    names = spark.createDataFrame([(c, i) for i, c in enumerate(columns)], "node string, pos long")
    listed = rows.select(F.col("source").alias("node"), F.col("_at").alias("pos"), F.lit(0).alias("side")).unionByName(
        names.withColumn("side", F.lit(1)))
    first = listed.groupBy("node").agg(F.min(F.struct("side", "pos")).alias("place"))
    nodes = first.select("node", (F.row_number().over(Window.orderBy("place")) - 1).alias("idx"))
    sources = nodes.toDF("source", "source_idx").withColumn("_one", F.lit(1))
    targets = nodes.toDF("target", "target_idx").withColumn("_one", F.lit(1))
    # The dense matrix is the result: every label with every label.
    return (sources.join(targets, "_one").join(cells, ["source", "target"], "left")
            .select(F.lit(station).alias("station"), F.lit(graph_type).alias("graph_type"), "source", "target",
                    "source_idx", "target_idx", F.coalesce("weight", F.lit(0.0)).alias("weight")))


def read_features(spark: SparkSession, scaled_path: str, cleaned_path: str, fmt: str = "parquet") -> DataFrame:
    """The scaled table, or the cleaned one where there is none, without non-feature columns."""
    def load(path: str) -> DataFrame:
        reader = spark.read.format(fmt)
        if fmt == "csv":
            reader = reader.option("header", "true").option("inferSchema", "true")
        return reader.load(path)

    path = scaled_path if _exists(spark, scaled_path) else cleaned_path
    return load(path).drop(*NON_FEATURES)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_embeddings(embeddings: DataFrame, path: str) -> None:
    """Embeddings laid out by station and run."""
    embeddings.write.mode("overwrite").partitionBy("station", "run").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("node string, embedding array<double>, station string, run string").parquet(path).select(
        "station", "run", "node", "embedding")


def read_embedding_csvs(spark: SparkSession, folder: str, station: str) -> DataFrame:
    """All ``<run>_embeddings.csv`` files of a folder: a label column, then one column per dimension.

    Files may differ in width, so lines are split rather than read under one header.
    """
    lines = spark.read.option("pathGlobFilter", "*_embeddings.csv").text(folder).select(
        F.regexp_extract("_metadata.file_name", "^(.*)_embeddings\\.csv$", 1).alias("run"),
        F.split("value", ",").alias("cells"))
    # The header's first cell, the index name, is empty.
    return (lines.where(F.col("cells")[0] != "").select(
        F.lit(station).alias("station"), "run", F.col("cells")[0].alias("node"),
        F.transform(F.slice("cells", 2, F.size("cells") - 1), lambda v: v.cast("double")).alias("embedding")))
