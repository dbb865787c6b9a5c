"""Headers on the executors, and multi-line files from many splits: the rows of the one-task reader."""

import random

import pytest
from pyspark.sql import functions as F

from cometa.sources import csv_split as cs
from cometa.sources.csv_audit import csv_reader, read_audit_csv, read_by_header, list_sizes

PIECES = ["a", "b c", "", "é漢", 'say ""hi""', "x;y", "line\nend", "two\n\nends\n", '""', "1", " q ", "\r\n", '"";""', "\n;\n"]


def random_record(rng, columns):
    out = []
    for _ in range(rng.randrange(max(1, columns - 1), columns + 2)):  # ragged
        if rng.random() < 0.6:
            out.append('"' + "".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 4))) + '"')
        else:
            out.append(rng.choice(["", "plain", "5' pipe", 'in"ner', "é", " lead", "7"]))
    return ";".join(out)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("split", [48, 200])
def test_rows_of_the_one_task_reader(spark, tmp_path, seed, split):
    rng = random.Random(seed)
    head = 'N. Serie;"Coment\nleitura";Data'
    text = head + "\n" + "\n".join(rng.choice([random_record(rng, 3), random_record(rng, 3), ""]) for _ in range(120))
    (tmp_path / "one.csv").write_text(text + rng.choice(["", "\n"]), newline="")
    path = f"file:{tmp_path}/one.csv"
    want = csv_reader(spark, ";", True).csv(path)
    with cs.held_settings(spark, spark__sql__files__maxPartitionBytes=str(split), spark__sql__files__openCostInBytes="1"):
        files = list_sizes(spark, path)
        assert files[path] > 8 * split
        got = cs.read_split_csv(spark, list(files), want.columns, ";")
        assert got.rdd.getNumPartitions() >= 8
        assert rows(got) == rows(want)


def test_a_quoted_line_end_at_every_split_edge(spark, tmp_path):
    """Records of 32 bytes, each with a line end in a field at its 16th byte: splits of 16 bytes end there or between records."""
    lines = ["k;t"] + [f'{k:06d};"abcdefg\nhijklmn xyz"' for k in range(64)]
    (tmp_path / "x.csv").write_text("\n".join(lines) + "\n")
    path = f"file:{tmp_path}/x.csv"
    with cs.held_settings(spark, spark__sql__files__maxPartitionBytes="16", spark__sql__files__openCostInBytes="1"):
        got = cs.read_split_csv(spark, [path], ["k", "t"], ";")
        assert got.rdd.getNumPartitions() >= 64 and any(cs.split_states(spark, [path], ";")[0].values())
        assert rows(got) == [(f"{k:06d}", "abcdefg\nhijklmn xyz") for k in range(64)]


@pytest.mark.parametrize("text", ["a;b\n1;2", "a;b\n", "a;b\r\n1;\"x\r\ny\"\r\n2;3\r\n", 'a;b\n1;"never closed\n2;3', "\n\na;b\n\n1;2\n\n", 'a;b\n1;2\r\n"x\r\ny";3\r\n', 'a;b\r\n1;"x\ny\r"\r\n\r\n"\r\n";\r\n', 'a;b\n"x"y;"2"\n"p" ;3\n'])
def test_odd_files(spark, tmp_path, text):
    (tmp_path / "o.csv").write_text(text, newline="")
    path = f"file:{tmp_path}/o.csv"
    want = csv_reader(spark, ";", True).csv(path)
    for split in ("8", "134217728"):
        with cs.held_settings(spark, spark__sql__files__maxPartitionBytes=split, spark__sql__files__openCostInBytes="1"):
            assert rows(cs.read_split_csv(spark, [path], want.columns, ";")) == rows(want)


def test_state_of_a_line():
    for line, inside, want in [("a;b", False, False), ('a;"b', False, True), ('a;"b";c', False, False), ('a;b"c', False, False), ('x";"y', True, True), ('x"";y', True, True),
                               ('x"""', True, False), ('""', True, True), ('"a""', False, True), ('"a" b;"c', False, True), ("", True, True), ("", False, False), ('a;"', False, True)]:
        assert cs.ends_inside(line, inside, ";") is want, (line, inside)


def _jobs(spark, run):
    spark.sparkContext.setJobGroup("count", "count")
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup("count"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_two_thousand_headers_in_three_jobs(spark, tmp_path):
    for k in range(2000):
        head = 'Nota leit;"Coment\nleitura";Data' if k % 2 else '"Coment\nleitura";Extra;Nota leit;Data'
        row = f"n{k};c{k};2024" if k % 2 else f"c{k};e;n{k};2024"
        (tmp_path / f"f{k:04d}.csv").write_text(f"{head}\n{row}\n")
    files = list_sizes(spark, f"file:{tmp_path}/*.csv")
    df, jobs = _jobs(spark, lambda: read_by_header(spark, files, ";", True))
    assert jobs <= 3
    got = df.agg(F.count("*"), F.sum((F.substring("Nota_leit", 2, 9) == F.substring("Comentleitura", 2, 9)).cast("int")), F.count("Extra")).first()
    assert tuple(got) == (2000, 2000, 1000)


def test_headers_of_odd_paths_and_empty_files(spark, tmp_path):
    (tmp_path / "a b%20c.csv").write_text("x;y\n1;2\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "é.csv").write_text('\n"y";x\n3;4\n')
    files = list_sizes(spark, f"file:{tmp_path}/*.csv")
    for size in (0, cs.SMALL + 1):  # as small files and as large ones
        found = cs.read_headers(spark, dict.fromkeys(files, size), ";")
        assert found == {f"file:{tmp_path}/a b%20c.csv": "x;y", f"file:{tmp_path}/é.csv": '"y";x'}
    assert rows(read_by_header(spark, files, ";", True).select("x", "y")) == [("1", "2"), ("4", "3")]


def test_large_and_small_files_of_two_layouts_through_the_audit_reader(spark, tmp_path):
    big = "\n".join(f'n{k};"c\n{k}";2024' for k in range(500))
    (tmp_path / "big.csv").write_text(f"Nota;Comentario;Data\n{big}\n")
    (tmp_path / "small.csv").write_text('Comentario;Nota;Data\n"c\n500";n500;2024\nx;y;\n')
    with cs.held_settings(spark, spark__sql__files__maxPartitionBytes="512"):
        df = read_audit_csv(spark, f"file:{tmp_path}", date_required=True)
        got = rows(df.select("Nota", "Comentario"))
    assert got == sorted([(f"n{k}", f"c\n{k}") for k in range(501)], key=str)
