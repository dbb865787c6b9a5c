"""Delimited audit extracts: scan, header normalization, null spellings.

Every column is read as STRING (leading zeros in codes and serial numbers
matter to the rules). ``multiLine`` is on by default because quoted fields --
headers included -- may contain newlines. Spark reads such a file in one task, so
files larger than a split are read by ``csv_split`` instead, from all their splits,
with the same rows. When a scan has fewer splits than the cluster has cores it is
followed by a round-robin repartition that spreads the per-row rule work; a
folder of many files is left as it is. Pass ``multi_line=False`` for extracts
known to hold one record per line. Headers are read by the executors.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cometa.plans.partitioning import spread_for_cpu
from cometa.sources.csv_split import listing, read_headers, read_split_csv, split_bytes

# ---------------------------------------------------------------------------
# Spellings read as null by the original CSV reader (its
# defaults; the empty string included).
# ---------------------------------------------------------------------------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
DATE_COLUMN = "Data"
# ---------------------------------------------------------------------------


def normalize_header(name: str, legacy_double_strip: bool = False) -> str:
    """Outer white space goes, then line ends and dots inside go and each
    space becomes an underscore.

    ``legacy_double_strip`` strips once more where dropping line ends has
    bared white space (one of the older scripts did).
    """
    outer = str(name).strip()
    one_line = re.sub(r"[\r\n]", "", outer)
    return re.sub(r"[. ]", lambda m: "_" if m[0] == " " else "", one_line.strip() if legacy_double_strip else one_line)


def normalize_columns(df: DataFrame, legacy_double_strip: bool = False) -> DataFrame:
    """Rename all columns (metadata only); colliding names get ``_2``, ``_3``..."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = normalize_header(c, legacy_double_strip)
        if n in seen:
            seen[n] += 1
            n = f"{n}_{seen[n]}"
        else:
            seen[n] = 1
        names.append(n)
    return df.toDF(*names)


def null_na_tokens(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """P10: the default null spellings become null (Spark's ``nullValue``
    takes a single string)."""
    cols = cols if cols is not None else df.columns
    return df.withColumns({c: F.when(~F.col(c).isin(NA_TOKENS), F.col(c)) for c in cols})


def keep_dated(df: DataFrame, date_col: str = DATE_COLUMN, required: bool = False) -> DataFrame:
    """Keep rows with a non-empty date when the column exists (S3 makes
    it mandatory)."""
    if date_col not in df.columns:
        if required:
            raise KeyError(date_col)
        return df
    d = F.col(date_col)
    return df.where(d.isNotNull() & (d != ""))


def csv_options(reader, sep: str, multi_line: bool):
    """The options of every extract reader, batch or stream."""
    return (
        reader.option("sep", sep)
        .option("header", True)
        .option("inferSchema", False)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("encoding", "UTF-8")
    )


def csv_reader(spark: SparkSession, sep: str, multi_line: bool):
    return csv_options(spark.read, sep, multi_line)


def list_sizes(spark: SparkSession, pattern: str, exclude: list[str] | None = None) -> dict[str, int]:
    """The files that a path, folder or glob names, sorted, with their bytes,
    through the file system that Spark reads; hidden files and paths holding an
    excluded string (compared with the decoded path) are left out."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = {}
    for found in fs.globStatus(path) or []:
        inside = fs.listStatus(found.getPath()) if found.isDirectory() else [found]
        out.update({f.getPath().toString(): f.getLen() for f in inside if f.isFile() and f.getPath().getName()[0] not in "._"})
    return {f: out[f] for f in sorted(out) if not any(x in f for x in exclude or [])}


def list_files(spark: SparkSession, pattern: str, exclude: list[str] | None = None) -> list[str]:
    return list(list_sizes(spark, pattern, exclude))


def concat_tables(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables, columns matched by name, missing ones null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def read_by_header(spark: SparkSession, files: dict[str, int] | list[str], sep: str, multi_line: bool, legacy_double_strip: bool = False) -> DataFrame:
    """Scans by distinct header, columns matched by their normalized names.

    A scan applies one header to all of its files, so files are grouped by their
    header, which the executors read. ``files`` may give their bytes; multi-line files larger than a split are read from all their splits.
    """
    sizes = files if isinstance(files, dict) else dict.fromkeys(files, 0)
    headers = read_headers(spark, sizes, sep)
    groups: dict[str, list[str]] = {}
    for f in sizes:
        # a file without a record has no columns and no rows, unless its first split is all empty lines
        header = headers.get(f) or ("\n".join(csv_reader(spark, sep, multi_line).csv(f).columns) if sizes[f] else None)
        if header is not None:
            groups.setdefault(header, []).append(f)
    if not groups:
        raise ValueError("the files hold no header")
    tables = []
    for own in groups.values():
        names = csv_reader(spark, sep, multi_line).csv(own[0]).columns
        large = [f for f in own if multi_line and sizes[f] > split_bytes(spark)]
        small = [f for f in own if f not in set(large)]
        if small:
            schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
            with listing(spark, small):
                tables.append(normalize_columns(csv_reader(spark, sep, multi_line).schema(schema).csv(small), legacy_double_strip))
        if large:
            tables.append(normalize_columns(read_split_csv(spark, large, names, sep), legacy_double_strip))
    return concat_tables(tables)


def _spread(df: DataFrame) -> DataFrame:
    """Spread the rule work when the scan has fewer splits than cores (one
    unsplittable multi-line file); many files already give many splits and
    are left as they are. ``df`` is the scan plus narrow steps only."""
    return spread_for_cpu(df)


def read_audit_csv(
    spark: SparkSession,
    path: str,
    sep: str = ";",
    multi_line: bool = True,
    date_required: bool = False,
    legacy_double_strip: bool = False,
) -> DataFrame:
    """Scan -> normalized headers -> null spellings -> dated rows.

    A directory or glob reads every file and matches columns by name; rows
    longer than their header are truncated and shorter ones padded with nulls
    (PERMISSIVE).
    """
    files = list_sizes(spark, path)
    if not files:
        raise ValueError(f"no file found for {path}")
    df = null_na_tokens(read_by_header(spark, files, sep, multi_line, legacy_double_strip))
    return _spread(keep_dated(df, required=date_required))


def read_training_csvs(
    spark: SparkSession, pattern: str, exclude: list[str] | None = None, sep: str = ";", multi_line: bool = True
) -> DataFrame:
    """All files matching ``pattern`` whose full path contains none of
    ``exclude``, columns matched by name; raises when no file is left."""
    files = list_sizes(spark, pattern, exclude)
    if not files:
        raise ValueError(f"no training file left for {pattern} after excluding {exclude}")
    return _spread(null_na_tokens(read_by_header(spark, files, sep, multi_line)))


def read_train_and_target(spark: SparkSession, train: str, target: str, exclude: list[str] | None = None, sep: str = ";", multi_line: bool = True) -> DataFrame:
    """S6 + U1: training and target extracts as one table, columns matched by
    name; ``part`` is 'train' or 'target'."""
    a = read_training_csvs(spark, train, exclude, sep, multi_line).withColumn("part", F.lit("train"))
    b = null_na_tokens(read_by_header(spark, list_sizes(spark, target), sep, multi_line)).withColumn("part", F.lit("target"))
    return concat_tables([a, b])


def read_labelled_csv(
    spark: SparkSession,
    path: str,
    text_col: str,
    class_col: str,
    sigla_col: str | None = None,
    sep: str = ",",
    multi_line: bool = True,
) -> DataFrame:
    """S5 + P7: project (comentario, classificacao[, sigla]) and drop rows
    without text or class; a missing sigla is kept."""
    raw = null_na_tokens(csv_reader(spark, sep, multi_line).csv(path))
    cols = [F.col(f"`{text_col}`").alias("comentario"), F.col(f"`{class_col}`").alias("classificacao")]
    if sigla_col:
        cols.append(F.col(f"`{sigla_col}`").alias("sigla"))
    return _spread(raw.select(*cols).na.drop(how="any", subset=["comentario", "classificacao"]))


def validated_path(input_path: str, suffix: str = "_VALIDADO") -> str:
    """S7 naming: ``<input stem>_VALIDADO`` beside the input."""
    return re.sub(r"(\.[^./]+)?$", suffix, input_path.rstrip("/"), count=1)


def write_validated(df: DataFrame, out_path: str, fmt: str = "parquet", mode: str = "overwrite", sep: str = ";") -> None:
    """The full table with its analysis column."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("sep", sep).option("escape", '"').csv(out_path)
    else:
        w.format(fmt).save(out_path)
