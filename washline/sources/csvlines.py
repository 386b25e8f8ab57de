"""CSV records from files that are read in parts, whatever line breaks their fields hold.

A line break ends a record only outside quotes, and whether a line starts inside quotes depends on all lines
before it. What a line does to that is one of four things: leave it as it is, turn it around, end outside or
end inside; and doing one after the other is again one of the four. So every block of a file is reduced to
one of them by the task that reads it; a running composition over the blocks, one small row each, says how
each block starts; and a second scan joins lines to records. The pieces of a record that lies across a
block's edge meet by the block it starts in. Records are then parsed by Spark (``from_csv``).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.checkpoints import stored

BROADCAST_BYTES = 8 << 20
LONG_RUN = 256
BLANK = pa.array([b"", b"\r"], pa.binary())
MARK = "\ufeff"  # some writers put it at a file's start
COMPLETE, BEGUN, CONTINUED = 0, 1, 2
RECORDS = pa.schema([
    ("file", pa.int64()), ("block", pa.int64()), ("place", pa.int64()), ("kind", pa.int32()), ("value", pa.binary()),
])

# A quote opens a field only at its start, and is doubled inside; whatever follows the closing one is
# text up to the next comma.
_QUOTED = rb'"(?:[^"]++|"")*+'
_FIELDS = rb'(?:(?:' + _QUOTED + rb'"[^,]*+|[^",][^,]*+|),)*+'
OPENS = re.compile(_FIELDS + _QUOTED + rb"\Z")
STAYS = re.compile(rb'(?:[^"]++|"")*+(?:\Z|"[^,]*+,' + _FIELDS + _QUOTED + rb"\Z)")


def step(line: bytes) -> tuple[bool, bool]:
    """Whether the line ends inside quotes: if it starts outside, and if it starts inside."""
    return OPENS.match(line) is not None, STAYS.match(line) is not None


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The batch cut where the file or the block changes."""
    files, blocks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
    cuts = (np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist()
    for start, end in zip([0, *cuts], [*cuts, batch.num_rows] if batch.num_rows else []):
        yield (int(files[start]), int(blocks[start])), batch.slice(start, end - start)


def _with_quotes(lines: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.count_substring(lines, b'"').to_numpy(zero_copy_only=False))


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(file, block, outside, inside)``: how a block ends by how it starts. A block that comes in several
    batches is one row."""
    seen: dict[tuple[str, int], tuple[bool, bool]] = {}
    for batch in batches:
        for key, part in _blocks(batch):
            ends = seen.get(key, (False, True))
            lines = part.column(0)
            for i in _with_quotes(lines):
                after = step(lines[int(i)].as_py())
                ends = after[ends[0]], after[ends[1]]
            seen[key] = ends
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in seen], pa.int64()), pa.array([k[1] for k in seen], pa.int64()),
         pa.array([e[0] for e in seen.values()], pa.bool_()), pa.array([e[1] for e in seen.values()], pa.bool_())],
        ["file", "block", "outside", "inside"],
    )


class _Out:
    """Records of one task on their way out."""

    def __init__(self):
        self.rows: list[tuple[int, int, int, int, bytes]] = []
        self.size = 0

    def add(self, key: tuple[int, int], place: int, kind: int, value: bytes) -> None:
        self.rows.append((*key, place, kind, value))
        self.size += len(value)

    def full(self) -> bool:
        return len(self.rows) >= 4096 or self.size > 8 << 20

    def taken(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), RECORDS)]
            self.rows, self.size = [], 0
            yield pa.RecordBatch.from_arrays(columns, schema=RECORDS)


def _plain(key: tuple[int, int], place: int, lines: pa.Array) -> pa.RecordBatch:
    """Lines that are records each."""
    n = len(lines)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n, key[0])), pa.array(np.full(n, key[1])), pa.array(np.arange(place, place + n)),
        pa.array(np.full(n, COMPLETE, np.int32)), lines,
    ], schema=RECORDS)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``RECORDS`` from ``(value, file, block, starts_inside)``, in order within a block."""
    out = _Out()
    current, inside, buffer, place = None, False, [], 0
    continued = False  # the buffer belongs to a record of an earlier block
    for batch in batches:
        for key, part in _blocks(batch):
            if key != current:
                if buffer:
                    out.add(current, place, CONTINUED if continued else BEGUN, b"\n".join(buffer))
                if not part.column(3)[0].is_valid:
                    raise ValueError("a file is cut or filled otherwise than when it was first read: read it again")
                current, buffer, place = key, [], 0
                inside = continued = part.column(3)[0].as_py()
            lines = part.column(0)
            at = 0
            for i in [*_with_quotes(lines).tolist(), len(lines)]:
                run = lines.slice(at, i - at)
                if inside:
                    buffer += run.to_pylist()
                elif len(run):
                    run = run.filter(pc.invert(pc.is_in(run, BLANK)))
                    if len(run) >= LONG_RUN:
                        yield from out.taken()
                        yield _plain(key, place, run)
                    else:
                        for n, line in enumerate(run.to_pylist()):
                            out.add(key, place + n, COMPLETE, line)
                    place += len(run)
                at = i + 1
                if i == len(lines):
                    break
                line = lines[i].as_py()
                inside = step(line)[inside]
                buffer.append(line)
                if not inside:
                    out.add(key, place, CONTINUED if continued else COMPLETE, b"\n".join(buffer))
                    buffer, place, continued = [], place + 1, False
                if out.full():
                    yield from out.taken()
        yield from out.taken()
    if buffer:
        out.add(current, place, CONTINUED if continued else BEGUN, b"\n".join(buffer))
    yield from out.taken()


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``(value, file, block, path)``, a row a line, cut at line feeds only; in order within a task.

    Where Spark cuts files depends on the session and on how many executors there are just now, and both
    scans must cut alike: the files are read by a session of their own that holds what the cuts follow.
    """
    own = spark.newSession()
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    # carriage returns stay, as they may stand inside quotes
    lines = own.read.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("value"), F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_path").alias("path"),
    )
    return spark.createDataFrame([], lines.schema).union(lines)  # all that follows is the caller's session


def starts(lines: DataFrame) -> DataFrame:
    """``(file, block, starts_inside)``, a row a block, written."""
    ends = lines.select("value", "file", "block").mapInArrow(
        _states, "file long, block long, outside boolean, inside boolean"
    )
    # the last block before that ends alike however it starts, and the blocks since that turn it around
    fixed = F.when(F.col("outside") == F.col("inside"), F.col("outside").cast("int"))
    turns = (F.col("outside") & ~F.col("inside")).cast("int")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    known = F.last(F.when(fixed.isNotNull(), F.struct(fixed.alias("to"), F.col("turned").alias("at"))), ignorenulls=True)
    state = ends.withColumn("turned", F.sum(turns).over(order)).select(
        "file", "block", known.over(before).alias("known"),
        F.coalesce(F.lag("turned").over(order), F.lit(0)).alias("turned"),
    )
    since = F.coalesce(F.col("known.to") + F.col("turned") - F.col("known.at"), F.col("turned"))
    return stored(state.select("file", "block", (F.pmod(since, F.lit(2)) == 1).alias("starts_inside")))


def _join_states(lines: DataFrame, states: DataFrame) -> DataFrame:
    if 32 * states.count() <= BROADCAST_BYTES:
        joined = lines.join(F.broadcast(states), ["file", "block"], "left")  # keeps the order of the lines
    else:
        numbered = lines.withColumn("line", F.monotonically_increasing_id())
        joined = numbered.join(states, ["file", "block"], "left").sortWithinPartitions("file", "block", "line")
    return joined.select("value", "file", "block", "starts_inside")


def records(lines: DataFrame) -> DataFrame:
    """``(file, first, value)``: every record's text without its line end; ``first`` marks a file's first one.
    Lines that are empty outside quotes are no records."""
    states = starts(lines)
    made = _join_states(lines.select("value", "file", "block"), states).mapInArrow(
        _records, "file long, block long, place long, kind int, value binary"
    )
    whole = made  # at most a field that the file's end leaves open is no whole record
    if states.where("starts_inside").limit(1).count():
        whole = made.where(F.col("kind") == COMPLETE).unionByName(
            _rejoined(made.where(F.col("kind") != COMPLETE), states)
        )
    text, first = F.col("value").cast("string"), (F.col("block") == 0) & (F.col("place") == 0)
    text = F.when(F.endswith(text, F.lit("\r")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return whole.select(
        "file", first.alias("first"), F.when(first, F.ltrim(text, F.lit(MARK))).otherwise(text).alias("value")
    )


def _rejoined(pieces: DataFrame, states: DataFrame) -> DataFrame:
    """Records that lie across blocks, from a piece of each block. Blocks are few rows, records short."""
    begins = pieces.where(F.col("kind") == BEGUN).select("file", "block").withColumn("begins", F.lit(True))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("begins"), F.col("block")), ignorenulls=True).over(before)
    owners = states.join(begins, ["file", "block"], "left").withColumn("owner", owner).select("file", "block", "owner")
    owned = pieces.join(owners, ["file", "block"]).withColumn(
        "owner", F.when(F.col("kind") == BEGUN, F.col("block")).otherwise(F.col("owner"))
    )
    joined = owned.groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("block", "place", "value"))).alias("parts")
    )
    text = F.array_join(F.transform("parts", lambda p: p["value"].cast("string")), "\n")
    return joined.select(
        "file", F.col("owner").alias("block"), F.get("parts", F.lit(0))["place"].alias("place"),
        F.lit(COMPLETE).alias("kind"), text.cast("binary").alias("value"),
    )


def read_csv(
    spark: SparkSession, path: str, options: dict, schema: T.StructType | None, sampling_ratio: float | None
) -> DataFrame:
    """The table of a file, or of all files of a folder; each has a header, and the first one's counts."""
    lines = lines_of(spark, path)
    every = records(lines)
    heads = stored(every.where("first").select("file", "value"))
    if heads.count() > 1:
        leader = lines.where(F.col("block") == 0).agg(F.min(F.struct("path", "file"))["file"].alias("file"))
        heads = heads.join(F.broadcast(leader), "file")
    header = heads.first()
    if header is None:
        return spark.createDataFrame([], schema or T.StructType([]))
    body = every.where(~F.col("first")).select("value")
    if schema is None:
        reader = spark.read.options(**options).option("inferSchema", True)
        if sampling_ratio is not None:
            reader = reader.option("samplingRatio", sampling_ratio)
        schema = _inferred(reader, spark.createDataFrame([(header["value"],)], "value string").union(body))
    ddl = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(schema))
    wanted = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if k != "header"}
    parsed = body.select(F.from_csv("value", ddl, wanted).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(f.name) for i, f in enumerate(schema)])


def _inferred(reader, texts: DataFrame) -> T.StructType:
    """What Spark's reader takes the types of the records to be; the first one is the header."""
    strings = texts.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING()
    found = reader._jreader.csv(getattr(texts._jdf, "as")(strings))
    return T.StructType.fromJson(json.loads(found.schema().json()))
