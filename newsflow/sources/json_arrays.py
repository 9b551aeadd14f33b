"""JSON array files of any size, read by many tasks and written as a stream.

A file is read in splits, as pieces that end at a closing brace. Whether such a brace ends a record depends on everything before it: is it inside
a string, and how deep? Each split is therefore scanned once for what it does to that state, for either state of the string it may begin in:
the parity of its quotes, its change of depth, and the depths its braces reach. Running sums over the (small) table of splits give the state that every
split begins with. A second scan then cuts the records: those that lie inside a split come out whole and never move; only the
parts of records at the borders of splits meet in a shuffle, by record.

One row per split goes through the driver, as the list of splits itself does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from newsflow.session import stage

# Escapes, and what may stand between the records of an array: separators and values that are no objects.
_ESCAPE = re.compile(r"\\.", re.S)
_BETWEEN = re.compile(r"""(?:[﻿\s,\[\]]+|"(?:[^"\\]|\\.)*"|[-+.0-9eE]+|true|false|null)*""", re.S)

_SUMMARY = "file string, block long, first string, flips int, change_out int, change_in int, depths_out array<int>, depths_in array<int>"
_PARTS = "file string, block long, seq long, join long, text string"


def _outside(piece: str, in_string: bool) -> tuple[int, bool]:
    """Change of depth by the brackets outside strings, and whether the piece ends in a string. Its last brace is not part of it."""
    if "\\" in piece:
        # A closing brace can't be escaped, so no escape is cut in two.
        piece = _ESCAPE.sub("", piece)
    parts = piece.split('"')
    outside = "".join(parts[1 if in_string else 0 :: 2])
    change = outside.count("{") + outside.count("[") - outside.count("]")
    return change, in_string ^ (len(parts) % 2 == 0)


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        yield from zip(batch["file"].to_pylist(), batch["block"].to_pylist(), batch["value"].to_pylist())


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each split does to the state, whether it begins outside (0) or inside (1) a string."""

    def row() -> pa.RecordBatch:
        values = [[at[0]], [at[1]], [first], [int(state[0])], [change[0]], [change[1]], [sorted(depths[0])], [sorted(depths[1])]]
        kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int32()] * 3, *[pa.list_(pa.int32())] * 2]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in _SUMMARY.split(", ")]
        )

    at, first, state, change, depths = None, "", [False, True], [0, 0], [set(), set()]
    for file, block, piece in _splits(batches):
        if (file, block) != at:
            if at:
                yield row()
            at, first, state, change, depths = (file, block), piece.lstrip("﻿ \t\r\n")[:1], [False, True], [0, 0], [set(), set()]
        for k in (0, 1):
            more, state[k] = _outside(piece, state[k])
            change[k] += more
            if not state[k]:
                change[k] -= 1
                depths[k].add(change[k])
    if at:
        yield row()


def _cut(starts):
    """Records and parts of records of every split; a part carries the number of the record it belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "block", "seq", "join", "text"])
            rows.clear()
            return done

        def rest() -> None:
            """What the split has begun and not ended."""
            if pending:
                rows.append((*at, seq, joint, "".join(pending)))

        pending: list[str] = []
        seq, joint, size = 0, None, 0
        for file, block, piece in _splits(batches):
            if (file, block) != at:
                if at:
                    rest()
                at, pending, seq = (file, block), [], 0
                in_string, depth, base, joint = starts.value[at]
            more, in_string = _outside(piece, in_string)
            depth += more - (not in_string)
            pending += (piece, "}")
            if not in_string and depth == base:
                text = "".join(pending)
                # The first end in a split closes a record that may have begun before it.
                rows.append((*at, seq, joint if seq == 0 else None, text))
                pending, size = [], size + len(text)
                joint = joint + 1 if seq == 0 else joint
                seq += 1
            if len(rows) >= 2_000 or size > 8 << 20:
                yield flush()
                size = 0
        if at:
            rest()
        yield flush()

    return run


def _begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop what stands before a record; what is no record goes."""
    for batch in batches:
        texts = [t[_BETWEEN.match(t).end() :] for t in batch["text"].to_pylist()]
        keep = pa.array([t.startswith("{") and t.endswith("}") for t in texts])
        columns = [*[batch[c] for c in ("file", "block", "seq")], pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=["file", "block", "seq", "text"])


def record_texts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(file, block, seq, text)``: the text of every record, with its place: the split it begins in, and its number there."""
    scan = spark.read.option("lineSep", "}").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    splits = stage(scan.mapInArrow(_summaries, _SUMMARY), "json-splits")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    in_string = F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2 == 1
    strings = splits.withColumn("in_string", in_string).withColumn("base", F.min_by("first", "block").over(whole) == "[")
    chosen = strings.select(
        "file", "block", "in_string", F.col("base").cast("int").alias("base"), F.when(F.col("in_string"), F.col("change_in")).otherwise(F.col("change_out")).alias("change"),
        F.when(F.col("in_string"), F.col("depths_in")).otherwise(F.col("depths_out")).alias("depths"),
    )
    placed = chosen.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    ends = placed.withColumn("ends", F.array_contains("depths", F.col("base") - F.col("depth").cast("int")).cast("long"))
    # A record that crosses borders is numbered by the splits before it in which one ends.
    numbered = ends.withColumn("joint", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    starts = {
        (r["file"], r["block"]): (r["in_string"], int(r["depth"]), r["base"], r["joint"])
        for r in numbered.select("file", "block", "in_string", "depth", "base", "joint").collect()
    }
    parts = stage(scan.mapInArrow(_cut(spark.sparkContext.broadcast(starts)), _PARTS), "json-parts")
    pieces = F.sort_array(F.collect_list(F.struct("block", "seq", "text")))
    crossing = parts.filter("join IS NOT NULL").groupBy("file", "join").agg(pieces.alias("pieces")).select(
        "file", F.col("pieces")[0]["block"].alias("block"), F.col("pieces")[0]["seq"].alias("seq"), F.array_join(F.col("pieces")["text"], "").alias("text")
    )
    inside = parts.filter("join IS NULL").select("file", "block", "seq", "text")
    return inside.unionByName(crossing).mapInArrow(_begin, "file string, block long, seq long, text string")


def scan_json_array(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, positions: bool = False) -> DataFrame:
    """The objects of files that hold a JSON array, one object, or one object after another, in any layout.

    A file of any size is read by as many tasks as it has splits. Elements that aren't objects are left out; an object that can't be parsed gives
    nulls. With ``positions`` the columns ``_file``, ``_block`` and ``_row`` follow, which sort as the records stand in their files.
    """
    records = record_texts(spark, paths).select(
        F.from_json("text", schema).alias("record"), F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("seq").alias("_row")
    )
    fields = [F.col("record")[f.name].alias(f.name) for f in schema.fields]
    return records.select(*fields, *(["_file", "_block", "_row"] if positions else []))


def write_json_array(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Every part file is one JSON array of its rows, written as they come; nothing is gathered."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "[\n"
        for batch in batches:
            texts = [f"{mark if i == 0 else ',' + chr(10)}{t}" for i, t in enumerate(batch["value"].to_pylist())]
            if texts:
                mark = ",\n"
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if mark == "[\n" else "\n]"])], names=["value"])

    records = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    records.mapInArrow(lines, "value string").write.mode(mode).option("lineSep", "\n").text(path)
