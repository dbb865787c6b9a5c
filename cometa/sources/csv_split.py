"""Extracts whose quoted fields hold line ends, read from many splits at once.

Spark reads such a file in one task, since a line end may stand inside a field. Here
its physical lines are read in splits. Whether a line begins inside a quoted field
depends on all lines before it, but a split only maps one of two states (inside,
outside) to one of two: every task finds that map for its splits, the driver chains
the maps of each file (a row a split, as many as the scan's own split descriptors),
and a second scan cuts each split into records, knowing its first state. A record that
crosses splits is put together from its pieces, which are a small table of their own.
Records are parsed by Spark's own CSV parser. The rows are those of the one-task reader,
but for a field that is never closed: it ends before the file's last line end.

The same lines give the headers of any number of files, read by the executors.
"""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

QUOTE = '"'
# Up to this many files the driver lists them by itself; a listing job starts beyond it.
LISTED_BY_DRIVER = 10_000
SMALL = 4 << 20  # bytes of a file that is read to its end for its header
_DISCOVERY = "spark.sql.sources.parallelPartitionDiscovery.threshold"


@contextlib.contextmanager
def held_settings(spark: SparkSession, **settings: str):
    """Hold session settings (dots as double underscores) for the statements inside the block."""
    keys = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def listing(spark: SparkSession, files: list[str]):
    """Hold the listing of up to ``LISTED_BY_DRIVER`` files on the driver, without a job."""
    return held_settings(spark, **{_DISCOVERY.replace(".", "__"): str(max(32, min(len(files), LISTED_BY_DRIVER)))})


def file_key(path: str) -> str:
    """One spelling of a path, with one or three slashes after its scheme."""
    return re.sub(r"^([A-Za-z][\w+.-]*:)/+(?=[^/])", r"\1/", path)


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a line ends inside a quoted field, given whether it begins inside one.

    A quote opens a field only at its first character; a doubled quote inside stands for
    one; text between a closing quote and the separator belongs to the field.
    """
    at, size = 0, len(line)
    while True:
        if inside:
            at = line.find(QUOTE, at)
            if at < 0:
                return True
            at += 1
            if line[at : at + 1] == QUOTE:
                at += 1
                continue
        elif line[at : at + 1] == QUOTE:
            inside = True
            at += 1
            continue
        inside = False
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)
        if at >= size:
            return False


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """Physical lines without their line feed, in the order of each split, with file and split start."""
    with listing(spark, files):
        lines = spark.read.option("lineSep", "\n").text(files)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, split start, lines) of each stretch of a batch that stands in one split."""
    if not batch.num_rows:
        return
    keys = pa.StructArray.from_arrays([batch.column("file"), batch.column("start")], ["file", "start"])
    ends = pc.run_end_encode(batch.column("start")).run_ends.to_pylist()
    names = pc.run_end_encode(batch.column("file")).run_ends.to_pylist()
    a = 0
    for b in sorted({*ends, *names}):
        key = keys[a].as_py()
        yield key["file"], key["start"], batch.column("value").slice(a, b - a)
        a = b


def read_headers(spark: SparkSession, files: dict[str, int], sep: str) -> dict[str, str]:
    """The first record of each file that is no empty line; a file without one is left out.

    ``files`` gives the bytes of each. One job reads the small files, many a task; another,
    if there are larger ones, opens each in a task of its own and stops at its first record.
    """

    def first(alone: bool):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, inside, done = None, [], False, False
            for batch in batches:
                for file, start, lines in _runs(batch):
                    if now != file:
                        now, held, inside, done = file, [], False, start != 0
                    for line in () if done else lines.to_pylist():
                        if not held and not line.rstrip("\r"):
                            continue
                        held.append(line)
                        inside = ends_inside(line, inside, sep)
                        if not inside:
                            done = True
                            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array(["\n".join(held).rstrip("\r")])], ["file", "header"])
                            break
                    if done and alone:
                        return

        return task

    found = []
    small = [f for f, n in files.items() if n <= SMALL]
    large = [f for f, n in files.items() if n > SMALL]
    if small:
        found += _lines(spark, small).mapInArrow(first(False), "file string, header string").collect()  # a row a file, as the list of files
    if large:  # a split a file, a file a task, few lines a batch
        whole = dict.fromkeys(("spark__sql__files__openCostInBytes", "spark__sql__files__maxPartitionBytes"), str(1 << 50))
        with held_settings(spark, **whole, spark__sql__execution__arrow__maxRecordsPerBatch="64"):
            found += _lines(spark, large).mapInArrow(first(True), "file string, header string").collect()
    names = {file_key(f): f for f in files}
    return {names[file_key(unquote(r.file))]: r.header for r in found}


def split_bytes(spark: SparkSession) -> int:
    return int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


def split_states(spark: SparkSession, files: list[str], sep: str) -> tuple[dict[tuple[str, int], tuple[bool, bool, bool]], bool]:
    """Of each split: whether it begins inside a quoted field, whether its file's first line
    ends with a carriage return, and whether it holds the header; over all: whether any
    split ends inside a field."""

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[bool]] = {}
        more: dict[tuple[str, int], list[bool]] = {}  # a carriage return at the first line's end, a line that is not empty
        for batch in batches:
            for file, start, lines in _runs(batch):
                ends = found.setdefault((file, start), [False, True])  # the state after it, from either state
                seen = more.setdefault((file, start), [lines[0].as_py().endswith("\r"), False])
                seen[1] = seen[1] or any(x not in ("", "\r") for x in pc.unique(lines).to_pylist())
                for line in lines.filter(pc.match_substring(lines, QUOTE)).to_pylist():
                    ends[:] = [ends_inside(line, s, sep) for s in ends]
        if found:
            rows = [(*key, *ends, *more[key]) for key, ends in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["file", "start", "a", "b", "returns", "text"])

    maps = _lines(spark, files).mapInArrow(chained, "file string, start long, a boolean, b boolean, returns boolean, text boolean").collect()  # a row a split
    states, now, torn, returns, header = {}, False, False, False, False
    for r in sorted(maps, key=lambda r: (r.file, r.start)):
        if r.start == 0:
            now, returns, header = False, r.returns, True
        states[r.file, r.start] = now, returns, header and r.text
        header = header and not r.text
        now = r.b if now else r.a
        torn = torn or now
    return states, torn


def read_records(spark: SparkSession, files: list[str], sep: str) -> DataFrame:
    """``record``: the text of each record of the files, without their headers and empty lines."""
    found, any_torn = split_states(spark, files, sep)
    states = spark.sparkContext.broadcast(found)  # three flags a split

    def cut(pieces: bool):
        """Whole records, or the pieces of those that cross a split's edge (in order, ``opens``: a record's first)."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, inside, order, header, torn, returns = None, [], False, 0, False, False, False
            out: list[tuple] = []

            def end_of_split() -> None:
                if held and pieces:
                    out.append((*key, order, not torn, header, returns, "\n".join(held)))

            def batch_of() -> pa.RecordBatch:
                if pieces:
                    names = ["file", "start", "at", "opens", "header", "returns", "text"]
                    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
                    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out])], ["record"])

            for batch in batches:
                for file, start, lines in _runs(batch):
                    if key != (file, start):
                        end_of_split()
                        key, held, order = (file, start), [], 0
                        inside, returns, header = states.value[key]  # header: until the file's first record is over
                        torn = inside
                    quoted = pc.match_substring(lines, QUOTE).to_pylist()
                    for line, q in zip(lines.to_pylist(), quoted):
                        if not held and not inside and (not line or returns and line == "\r"):
                            continue
                        held.append(line)
                        inside = ends_inside(line, inside, sep) if q else inside
                        if not inside:
                            if torn and pieces:
                                out.append((*key, order, False, False, returns, "\n".join(held)))
                            elif not torn and not header and not pieces:
                                out.append(("\n".join([x.removesuffix("\r") for x in held] if returns else held),))
                            held, torn, header, order = [], False, False, order + 1
                if out:
                    yield batch_of()
                    out = []
            if key:
                end_of_split()
            if out:
                yield batch_of()

        return task

    lines = _lines(spark, files)
    whole = lines.mapInArrow(cut(False), "record string")
    if not any_torn:
        return whole
    torn = lines.mapInArrow(cut(True), "file string, start long, at long, opens boolean, header boolean, returns boolean, text string")
    order = Window.partitionBy("file").orderBy("start", "at")  # at most two pieces a split
    number = F.sum(F.col("opens").cast("int")).over(order)
    joined = torn.withColumn("number", number).groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("start", "at", "text"))).alias("p"), F.max("header").alias("header"), F.max("returns").alias("returns"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    text = F.when(F.col("returns"), F.regexp_replace(text, "\r(\n|$)", "$1")).otherwise(text)
    return whole.unionByName(joined.where(~F.col("header")).select(text.alias("record")))


def read_split_csv(spark: SparkSession, files: list[str], names: list[str], sep: str) -> DataFrame:
    """The rows of files that have these columns (all strings), parsed as the one-task reader parses them."""
    schema = StructType([StructField(f"c{k}", StringType()) for k in range(len(names))])
    options = {"sep": sep, "quote": QUOTE, "escape": QUOTE, "mode": "PERMISSIVE", "multiLine": "true"}
    ddl = ", ".join(f"{f.name} string" for f in schema)
    parsed = read_records(spark, files, sep).select(F.from_csv("record", F.lit(ddl), options).alias("r"))
    return parsed.select(*[F.col(f"r.c{k}") for k in range(len(names))]).toDF(*names)
