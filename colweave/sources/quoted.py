"""Text tables whose quoted values go on over lines, read by many tasks per file.

Whether a line begins a record depends on all quotes before it.  Every split of a file is
walked once under both assumptions, that it starts outside quotes and that it starts
inside; the splits of a file are then chained from the file's start, which tells each
split its true state and the number of records before it.  Knowing these, each split is
walked once more and gives its records as they are; only the two ends of a split, which may
hold parts of a record, are brought together with their neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colweave.session import few_tasks, materialise, ready_workers

_SIDES = ("outside", "inside")
_SPLITS = "file_no int, block long, " + ", ".join(f"{kind}_{side} {t}" for side in _SIDES for kind, t in (("ends", "boolean"), ("record", "long")))
_PIECES = "file_no int, number long, block long, text string"
PIECES_AT_ONCE = 10_000


def ends_outside(line: str, inside: bool, separator: str) -> bool:
    """Whether quotes are closed at the end of ``line``; a quote opens only where a value begins."""
    at, size = 0, len(line)
    while True:
        if not inside:
            while at < size and line[at] != '"':
                at = line.find(separator, at) + 1
                if at == 0:
                    return True
            if at >= size:
                return True
            at += 1
        close = line.find('"', at)
        while close >= 0 and line.startswith('""', close):
            close = line.find('"', close + 2)
        if close < 0:
            return False
        at = line.find(separator, close + 1) + 1
        if at == 0:
            return True
        inside = False


def _is_blank(line: str) -> bool:
    return not line or line[0] in "\r\n " and not line.strip("\r\n ")


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(file_no, block, batch, first row, lines)`` of consecutive lines of one split, first columns of the batches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = (batch.column(i).to_numpy() for i in (0, 1))
        lines = batch.column(2).to_numpy(zero_copy_only=False).tolist()
        cuts = np.flatnonzero((np.diff(files) != 0) | (np.diff(blocks) != 0)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(lines)]):
            yield int(files[low]), int(blocks[low]), batch, int(low), lines[low:high]


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [field.split() for field in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def _survey(separator: str):
    """A row per split: whether it ends outside quotes and how many records it begins, under both assumptions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, split, states, records = [], None, [], []
        for file_no, block, _, _, lines in _by_split(batches):
            if (file_no, block) != split:
                if split:
                    done.append((*split, not states[0], records[0], not states[1], records[1]))
                split, states, records = (file_no, block), [False, True], [0, 0]
            (first, second), (n, m) = states, records
            for line in lines:
                if '"' in line:
                    n += not first
                    m += not second
                    first, second = not ends_outside(line, first, separator), not ends_outside(line, second, separator)
                elif not (first and second or _is_blank(line)):
                    # A blank line between records is none.
                    n += not first
                    m += not second
            states, records = [first, second], [n, m]
        if split:
            done.append((*split, not states[0], records[0], not states[1], records[1]))
        yield _rows(done, _SPLITS)

    return run


def _cut(separator: str):
    """The records of each split as they are, and with its ``block`` what it holds of a record that it shares with others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held, inside, number, begun, out = None, [], False, 0, False, []
        for file_no, block, batch, low, lines in _by_split(batches):
            if (file_no, block) != split:
                if held:
                    out.append((split[0], number, split[1], "\n".join(held)))
                split, held, begun = (file_no, block), [], False
                inside, number = batch.column(3)[low].as_py(), batch.column(4)[low].as_py()
            for line in lines:
                if not inside:
                    if _is_blank(line):
                        continue
                    number += 1
                    begun = True
                if '"' in line:
                    inside = not ends_outside(line, inside, separator)
                if inside:
                    held.append(line)
                elif held or not begun:
                    held.append(line)
                    out.append((file_no, number, None if begun else block, "\n".join(held)))
                    held = []
                else:
                    out.append((file_no, number, None, line))
            if len(out) > PIECES_AT_ONCE:
                yield _rows(out, _PIECES)
                out = []
        if held:
            out.append((split[0], number, split[1], "\n".join(held)))
        yield _rows(out, _PIECES)

    return run


def _chain(blocks: pd.DataFrame) -> pd.DataFrame:
    """State and number of records at the start of each split of one file: a row per split."""
    blocks = blocks.sort_values("block")
    inside, before, out = False, 0, []
    for row in blocks.itertuples():
        out.append((row.file_no, row.block, inside, before))
        before += row.record_inside if inside else row.record_outside
        inside = not (row.ends_inside if inside else row.ends_outside)
    return pd.DataFrame(out, columns=["file_no", "block", "starts_inside", "before"])


def read_records(spark: SparkSession, paths: list[str], separator: str, path_of) -> DataFrame:
    """``(file, number, record)`` of same-schema text files, headers left out, as a written table.

    Numbers follow the order in the file.  A quote that is never closed makes one record
    of the rest of its file.  Blank lines between records are left out.
    """
    names = spark.read.format("binaryFile").load(paths).select(path_of.alias("file")).distinct()
    names = materialise(names.select("file", F.row_number().over(Window.orderBy("file")).alias("file_no")))
    source = spark.read.text(paths, lineSep="\n")
    lines = few_tasks(source.select(path_of.alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"), source)
    # The lines of a split stay in order, so files and splits, whose list the driver holds anyway, are broadcast at any number.
    lines = ready_workers(lines).join(F.broadcast(names), "file").select("file_no", "block", "value")
    splits = lines.mapInArrow(_survey(separator), _SPLITS)
    states = materialise(splits.groupBy("file_no").applyInPandas(_chain, "file_no int, block long, starts_inside boolean, before long"))
    known = lines.join(F.broadcast(states), ["file_no", "block"]).select("file_no", "block", "value", "starts_inside", "before")
    pieces = few_tasks(materialise(known.mapInArrow(_cut(separator), _PIECES)))
    whole = pieces.where("block IS NULL").select("file_no", "number", F.col("text").alias("record"))
    spread = (pieces.where("block IS NOT NULL").groupBy("file_no", "number")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n")
                   .alias("record")))
    records = whole.unionAll(few_tasks(materialise(spread))).where("number > 1")
    return records.join(names, "file_no").select("file", "number", F.regexp_replace("record", "\r$", "").alias("record"))


# Shapes that every text of a kind has.  A cast that fails costs many times one that does not, or a look at the shape.
_BLANK = r"[\x00-\x20\x7f]*"
_WHOLE = f"^{_BLANK}[+-]?\\d+{_BLANK}$"
_SHAPES = {
    "int": _WHOLE, "bigint": _WHOLE,
    "double": f"^{_BLANK}[+-]?(\\d|\\.\\d|(?i:inf|nan))",
    # A year alone has at least four digits; before a point there are two colons.
    "timestamp": f"^{_BLANK}([+-]?\\d{{4,7}}{_BLANK}$|[+-]?\\d+[^.\\d]|[Tt])",
    "boolean": f"^{_BLANK}(?i:t|true|y|yes|1|f|false|n|no|0){_BLANK}$",
}


def cast_if_shaped(value, kind: str):
    """``try_cast``, tried only where the text may be of that kind."""
    return F.when(value.rlike(_SHAPES[kind]), value.try_cast(kind)) if kind in _SHAPES else value.try_cast(kind)


def _exact(value, kind: str):
    """A text as ``kind``, NULL if it has blanks around it or is something else."""
    return F.when(F.trim(value) == value, cast_if_shaped(value, kind))


def typed(records: DataFrame, columns: list[str], separator: str) -> DataFrame:
    """``(_file, _number, *columns)`` of records; a column becomes the narrowest type that holds all of its values."""
    names = [f"c{i}" for i in range(len(columns))]
    schema = ", ".join(f"{n} string" for n in names)
    parsed = records.select("file", "number", F.from_csv("record", schema, {"sep": separator, "escape": '"', "maxCharsPerColumn": "-1"})
                            .alias("row")).select(F.col("file").alias("_file"), F.col("number").alias("_number"), "row.*")
    kinds = ("int", "bigint", "double", "date", "timestamp", "boolean")
    counts = parsed.agg(*[F.count(n).alias(n) for n in names],
                        *[F.count(_exact(F.col(n), k)).alias(f"{n}_{k}") for n in names for k in kinds]).first()
    types = {n: next((k for k in kinds if counts[n] and counts[f"{n}_{k}"] == counts[n]), "string") for n in names}
    return parsed.select("_file", "_number", *[
        (F.col(n) if types[n] == "string" else _exact(F.col(n), types[n])).alias(c) for n, c in zip(names, columns)])
