"""Streaming audit: new extract files in a folder are labelled as they land.

The stream carries the names of new files; each micro-batch reads its files as the
batch job does, every file by its own header, so extracts whose columns stand in
another order are labelled alike. A batch is written to a folder of its own, which is
replaced when the batch is run again (after a lost driver), so every file is labelled
exactly once.

Running totals per (note, label) are kept the same way: a small table a batch, replaced
when the batch is repeated, folded into one table now and then. They survive restarts
and equal the batch job's counts over all files so far.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cometa.operators import stats
from cometa.operators.validate import audit
from cometa.plans.audit_job import ANALYSIS, prepare
from cometa.session import shared_path
from cometa.sources.csv_audit import keep_dated, null_na_tokens, read_by_header
from cometa.plans.partitioning import spread_for_cpu

FOLD_EVERY = 100  # batches whose totals are folded into one table
TOTALS = "nota string, analise string, n long"


def audit_files(spark: SparkSession, files: dict[str, int], sep: str = ";") -> tuple[DataFrame, str | None]:
    """The audited records of these files (name: bytes), and the note column, if there is one."""
    df = spread_for_cpu(keep_dated(null_na_tokens(read_by_header(spark, files, sep, multi_line=True))))
    df, nota_col, comment_col = prepare(df)
    return audit(df, comment_col=comment_col, nota_col=nota_col, analysis_col=ANALYSIS), nota_col


def _keyed_folder(spark: SparkSession, kind: str, output_dir: str) -> str:
    """A folder under the shared directory that a restarted stream finds again by its output folder."""
    return shared_path(spark, f"{kind}_{hashlib.sha1(output_dir.encode('utf-8')).hexdigest()[:16]}")


def start_audit_stream(
    spark: SparkSession,
    input_dir: str,
    output_dir: str,
    checkpoint_dir: str | None = None,
    sep: str = ";",
    available_now: bool = True,
    processing_time: str | None = None,
    totals_dir: str | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Start the streaming audit into ``output_dir`` (Parquet, partitioned by ``batch_id``).
    ``available_now`` processes what is there and stops; else run with ``processing_time``.
    The checkpoint and the totals default to folders under the cluster's shared
    ``spark.checkpoint.dir`` keyed by the output folder, so a restarted stream resumes."""
    totals_dir = totals_dir or _keyed_folder(spark, "audit_totals", output_dir)

    def label(batch: DataFrame, batch_id: int) -> None:
        files = {r.path: r.length for r in batch.collect()}  # the names that the source has logged for this batch
        if any(files.values()):
            audited, nota_col = audit_files(batch.sparkSession, files, sep)
            path = f"{output_dir}/batch_id={batch_id}"
            audited.write.mode("overwrite").parquet(path)
            written = batch.sparkSession.read.parquet(path)
            counts = stats.note_label_counts(written, nota_col, ANALYSIS)
            write_totals(counts, totals_dir, batch_id)

    # only names and sizes are asked for, so the source opens no file
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    names = source.load(input_dir).where("length > 0").select("path", "length")
    w = names.writeStream.foreachBatch(label).option("checkpointLocation", checkpoint_dir or _keyed_folder(spark, "audit_stream", output_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start()


def write_totals(counts: DataFrame, totals_dir: str, batch_id: int, fold_every: int = FOLD_EVERY) -> None:
    """Keep a batch's (nota, analise, n); at every ``fold_every``-th batch fold all before it into one table."""
    spark = counts.sparkSession
    if batch_id and batch_id % fold_every == 0:
        folded = running_totals(spark, totals_dir, before=batch_id)
        folded.coalesce(1).write.mode("overwrite").parquet(f"{totals_dir}/folded/upto={batch_id}")
    counts.select(*[F.col(c).cast(t) for c, t in (f.split(" ") for f in TOTALS.split(", "))]).coalesce(1).write.mode("overwrite").parquet(f"{totals_dir}/batches/batch_id={batch_id}")


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers N of the whole tables ``<name>=N`` in a folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{folder}/*=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(re.search(r"=(\d+)/_SUCCESS$", f.getPath().toString())[1]) for f in found)


def running_totals(spark: SparkSession, totals_dir: str, before: int | None = None) -> DataFrame:
    """(nota, analise, n) over all batches, or those ``before`` a batch: the last folded table and the batches after it."""
    folded = [n for n in _numbers(spark, f"{totals_dir}/folded") if before is None or n <= before]
    base = folded[-1] if folded else 0
    paths = [f"{totals_dir}/folded/upto={base}"] if folded else []
    paths += [f"{totals_dir}/batches/batch_id={n}" for n in _numbers(spark, f"{totals_dir}/batches") if n >= base and (before is None or n < before)]
    if not paths:
        return spark.createDataFrame([], TOTALS)
    return spark.read.schema(TOTALS).parquet(*paths).groupBy("nota", "analise").agg(F.sum("n").alias("n"))


def totals_of(spark: SparkSession, output_dir: str) -> DataFrame:
    """The running totals of the stream that writes to ``output_dir`` with the default folders."""
    return running_totals(spark, _keyed_folder(spark, "audit_totals", output_dir))
