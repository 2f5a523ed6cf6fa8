"""Records of delimited text whose quoted fields may hold line breaks, read in splits.

Where a split begins, nobody knows whether its first line starts a record or goes on inside quotes.
So each split is run through from both beginnings; what it does to either is a function of two
values, and these functions are composed in file order to give the true beginning of every split. A
second pass then cuts each split into records. Only the pieces of records that cross from one split
into another are shuffled (at most two a split) and put together; everything else stays where it was read.

A quote opens a field only at the field's beginning; inside, two quotes are one; behind the closing
quote, text up to the delimiter belongs to the field. Records end at ``\\n``, ``\\r\\n`` or a lone ``\\r`` outside
of quotes; line breaks inside of quotes stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path

#: From the beginning of a record: fields that end, then one that is still open where the text ends.
_OPENS = r'(?:(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+|),)*+"(?:[^"]|"")*+\Z'
#: From inside of quotes: they do not close, or they do and a later field opens.
_STAYS = rf'(?:[^"]|"")*+(?:\Z|"[^,]*+,{_OPENS})'
_RULES = (re.compile(_OPENS), re.compile(_STAYS))

_PIECE = "file bigint, block bigint, opens boolean, heads boolean, record string"


def after(line: str, inside: bool) -> bool:
    """Whether the text is inside of quotes behind ``line``, given whether it was before it."""
    if "\r" in line[:-1]:
        for part in line.split("\r"):
            inside = _RULES[inside].match(part) is not None
        return inside
    return _RULES[inside].match(line) is not None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its file and the first byte of its split."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Batches cut where a new split begins, with ``(file, block)``."""
    for b in batches:
        at = 0
        file, block = b["file"].to_numpy(), b["block"].to_numpy()
        cuts = [*(((file[1:] != file[:-1]) | (block[1:] != block[:-1])).nonzero()[0] + 1), b.num_rows]
        for end in cuts:
            if end > at:
                yield (int(file[at]), int(block[at])), b.slice(at, end - at)
            at = int(end)


def splits(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, from_start, from_inside, breaks)``: for each split whether its end is inside of quotes,
    from either beginning, and whether any line leaves quotes open that were closed before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, breaks = None, [False, True], False
        out = []
        for key, part in _by_split(batches):
            if key != now:
                if now is not None:
                    out.append((*now, *state, breaks))
                now, state, breaks = key, [False, True], False
            values = part["value"]
            for line in values.filter(pc.match_substring(values, '"')).to_pylist():
                opened = after(line, False)
                breaks = breaks or opened
                closed = after(line, True)
                state = [closed if s else opened for s in state]
        if now is not None:
            out.append((*now, *state, breaks))
        names = ["file", "block", "from_start", "from_inside", "breaks"]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    return _lines(spark, path).mapInArrow(run, "file bigint, block bigint, from_start boolean, from_inside boolean, breaks boolean")


def beginnings(found: DataFrame) -> DataFrame:
    """``(file, block, inside)``: whether each split begins inside of quotes, by composing the splits before it."""
    per_file = found.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("block", "from_start", "from_inside"))).alias("s"))
    none = F.expr("cast(array() as array<struct<block: bigint, inside: boolean>>)")
    start = F.struct(none.alias("done"), F.lit(False).alias("inside"))

    def step(acc, s):
        here = F.struct(s["block"].alias("block"), acc["inside"].alias("inside"))
        return F.struct(F.concat(acc["done"], F.array(here)).alias("done"), F.when(acc["inside"], s["from_inside"]).otherwise(s["from_start"]).alias("inside"))

    return per_file.select("file", F.explode(F.aggregate("s", start, step)["done"]).alias("b")).select("file", "b.block", "b.inside")


class _Cutter:
    """Cuts the lines of one split into records; ``header`` says whether the first record is to be left out."""

    def __init__(self, inside: bool, header: bool):
        self.inside, self.header = inside, header
        self.goes_on = inside  # what is held belongs to a record of an earlier split
        self.held: list[str] = []
        self.lead: str | None = None
        self.records: list[str] = []

    def end(self) -> None:
        text = "".join(self.held)
        self.held = []
        if self.goes_on:
            self.lead, self.goes_on = text, False
        elif self.header and text.strip():
            self.header = False
        else:
            self.records.append(text)

    def line(self, line: str) -> None:
        parts = line.split("\r")
        for k, part in enumerate(parts):
            if k and k == len(parts) - 1 and not part:
                break  # the line ended in \r\n, and the \r has been seen to
            self.inside = _RULES[self.inside].match(part) is not None if '"' in part else self.inside
            self.held.append(part)
            if self.inside:
                if k < len(parts) - 1:
                    self.held.append("\r")
            else:
                self.end()
        if self.inside:
            self.held.append("\n")

    def lines(self, values: pa.Array) -> None:
        quoted = pc.or_(pc.match_substring(values, '"'), pc.match_substring(values, "\r")).to_numpy(zero_copy_only=False).nonzero()[0].tolist()
        at = 0
        for k in [*quoted, len(values)]:
            plain = values.slice(at, k - at).to_pylist()
            if not self.inside and self.header:
                for p in plain:
                    self.line(p)
            elif not self.inside:
                self.records += plain
            else:
                self.held += [x for p in plain for x in (p, "\n")]
            if k < len(values):
                self.line(values[k].as_py())
            at = k + 1


def _cut(lines: DataFrame, begins: DataFrame, header: bool, pieces: bool) -> DataFrame:
    """Whole records (``pieces`` False) or the pieces of those that cross splits."""
    # one row a split, 24 bytes each: 20 MB for 100 TB
    rows = lines.join(F.broadcast(begins), ["file", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cutter = None, None

        def out(last: bool):
            rows = []
            if not pieces:
                rows = [(None, None, None, None, r) for r in cutter.records]
            elif last:
                if cutter.lead is not None:
                    rows.append((*now, False, False, cutter.lead))
                if cutter.held or cutter.inside:
                    # a split that never leaves the quotes is one piece that goes on
                    rows.append((*now, not cutter.goes_on, cutter.header, "".join(cutter.held)))
            cutter.records = []
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["file", "block", "opens", "heads", "record"])

        for key, part in _by_split(batches):
            if key != now:
                if cutter is not None:
                    yield out(True)
                now, cutter = key, _Cutter(part["inside"][0].as_py(), header and key[1] == 0)
            cutter.lines(part["value"])
            yield out(False)
        if cutter is not None:
            yield out(True)

    return rows.mapInArrow(run, _PIECE)


def _stitched(pieces: DataFrame, spark: SparkSession) -> DataFrame:
    """Records from their pieces: one begins at each piece that opens quotes."""
    path = scratch_path(spark, "csv-pieces")
    pieces.write.parquet(path)  # few, and otherwise each reading would scan the file again for them
    pieces = spark.read.schema(pieces.schema).parquet(path)
    order = F.struct("block", F.col("opens").cast("int").alias("late"))
    per_file = pieces.groupBy("file").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "opens"))).alias("s"))
    number = F.aggregate("s", F.struct(F.expr("cast(array() as array<struct<o: struct<block: bigint, late: int>, k: int>>)").alias("done"), F.lit(0).alias("k")),
                         lambda acc, x: F.struct(F.concat(acc["done"], F.array(F.struct(x["o"].alias("o"), (acc["k"] + x["opens"].cast("int")).alias("k")))).alias("done"),
                                                 (acc["k"] + x["opens"].cast("int")).alias("k")))["done"]
    numbered = per_file.select("file", F.explode(number).alias("n")).select("file", F.col("n.o").alias("o"), F.col("n.k").alias("k"))
    rows = pieces.withColumn("o", order).join(numbered, ["file", "o"])
    whole = rows.groupBy("file", "k").agg(F.max("heads").alias("heads"), F.sort_array(F.collect_list(F.struct("o", "record"))).alias("p"))
    return whole.where(~F.col("heads")).select(F.array_join(F.transform("p", lambda x: x["record"]), "").alias("record"))


@dataclass
class Records:
    """The records of a file or folder; ``breaks`` tells whether quoted fields hold line breaks at all."""

    spark: SparkSession
    path: str
    breaks: bool
    begins: DataFrame | None = None

    def frame(self, header: bool = True) -> DataFrame:
        """``(record)`` of every record that is not blank; ``header`` leaves out the first one of each file."""
        lines = _lines(self.spark, self.path)
        whole = _cut(lines, self.begins, header, pieces=False).select("record")
        pieces = _stitched(_cut(lines, self.begins, header, pieces=True), self.spark)
        return whole.union(pieces).where(F.trim(F.regexp_replace("record", r"\r$", "")) != "")


def find_records(spark: SparkSession, path: str) -> Records:
    """Run over the file once and see where its splits begin (one row a split is kept, in the shared folder)."""
    out = scratch_path(spark, "csv-splits")
    found = splits(spark, path)
    found.write.parquet(out)
    found = spark.read.schema(found.schema).parquet(out)
    if found.where("breaks").isEmpty():
        return Records(spark, path, False)
    return Records(spark, path, True, beginnings(found))
