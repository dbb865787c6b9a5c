"""Ingest (S1-S5, P1, P3, P10), the audit job (V18) and the streaming audit."""

import os

import pytest
from pyspark.sql import functions as F

from cometa.plans.audit_job import ANALYSIS, run_audit
from cometa.sources.csv_audit import (
    normalize_header,
    read_audit_csv,
    read_labelled_csv,
    read_training_csvs,
    validated_path,
)

HEADER = 'Nº Serie;"Nota leit";"Coment.leitura";"ANÁLISE";Data'
ROWS = [
    '0012;B111;12345 67890;NI;01/01/2024',
    '0013;B111;;C;01/01/2024',
    '0014;L121;qualquer;C;01/01/2024',
    '0015;E101;M123456;;01/01/2024',
    '0016;T181;"103 15040.";;01/01/2024',
    '0017;P111;NA;;01/01/2024',
    '0018;P111;12345 6789;;',
    '0019;T161;"texto ""entre aspas""";;02/01/2024',
]


def _write(path, lines, encoding="utf-8"):
    with open(path, "w", encoding=encoding) as f:
        f.write("\n".join(lines) + "\n")
    return path


@pytest.mark.parametrize(
    "raw,expected",
    [(" Nota leit ", "Nota_leit"), ("Coment.leitura", "Comentleitura"), ("Coment. leitura", "Coment_leitura"),
     ("Nº\nSerie", "NºSerie"), ("ANÁLISE", "ANÁLISE")],
)
def test_normalize_header(raw, expected):
    assert normalize_header(raw) == expected


def test_read_audit_csv(spark, tmp_path):
    p = _write(str(tmp_path / "a.csv"), [HEADER] + ROWS)
    df = read_audit_csv(spark, p)
    assert df.columns == ["Nº_Serie", "Nota_leit", "Comentleitura", "ANÁLISE", "Data"]
    rows = {r["Nº_Serie"]: r for r in df.collect()}
    assert "0018" not in rows  # no date -> dropped (P3)
    assert len(rows) == 7
    assert rows["0012"]["Nº_Serie"] == "0012"  # leading zeros kept (STRING)
    assert rows["0017"]["Comentleitura"] is None  # NA spelling -> null (P10)
    assert rows["0019"]["Comentleitura"] == 'texto "entre aspas"'  # doubled quotes undone
    assert rows["0013"]["Comentleitura"] is None


def test_header_with_newline(spark, tmp_path):
    p = _write(str(tmp_path / "b.csv"), ['"Nota\nleit";Coment', "B111;12345"])
    df = read_audit_csv(spark, p)
    assert df.columns == ["Notaleit", "Coment"]
    assert df.count() == 1


def test_ragged_rows(spark, tmp_path):
    p = _write(str(tmp_path / "r.csv"), ["a;b;c", "1;2;3;4", "5;6"])
    rows = read_audit_csv(spark, p).orderBy("a").collect()
    assert [tuple(r) for r in rows] == [("1", "2", "3"), ("5", "6", None)]


def test_run_audit(spark, tmp_path):
    p = _write(str(tmp_path / "mvc.csv"), [HEADER] + ROWS)
    out = str(tmp_path / "out")
    run = run_audit(spark, p, out, run_log_path=str(tmp_path / "runs"))
    got = {r["Nº_Serie"]: r[ANALYSIS] for r in run.validated.collect()}
    # prior labels are reset except on L121; then the rules label every row
    assert got == {"0012": "C", "0013": "SC", "0014": "C", "0015": "C", "0016": "UCE", "0017": "SC", "0019": "UCE"}
    dist = {r[ANALYSIS]: r["n"] for r in run.distribution.collect()}
    assert dist == {"C": 3, "SC": 2, "UCE": 2}
    kpi = run.kpi.first()
    assert kpi["ratio_text"] == "133,33%"
    assert run.before_totals.first()["filled_rows"] == 1
    worst = [tuple(r) for r in run.worst.collect()]
    assert worst[0] == ("B111", 1) or ("B111", 1) in worst
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 1
    assert validated_path("/x/mvc_0003.csv") == "/x/mvc_0003_VALIDADO"
    # statistics derived from the (note, label) counts equal the row-level ones
    from cometa.operators import stats

    v, n = run.validated, run.nota_col
    pairs = [
        (run.distribution, stats.label_distribution(v, ANALYSIS)),
        (run.kpi, stats.conformity_kpi(v, ANALYSIS)),
        (run.badges, stats.label_badges(v, ANALYSIS)),
        (run.crosstab, stats.note_label_crosstab(v, n, ANALYSIS)),
        (run.worst, stats.worst_notes(v, n, ANALYSIS)),
    ]
    for derived, direct in pairs:
        assert derived.columns == direct.columns
        assert [tuple(r) for r in derived.collect()] == [tuple(r) for r in direct.collect()]


def test_training_scan_excludes(spark, tmp_path):
    d = tmp_path / "train"
    d.mkdir()
    _write(str(d / "mvc_0001_test.csv"), ["Nota leit;Coment.leitura;ANÁLISE", "B111;1 2;C"])
    _write(str(d / "mvc_0002_test.csv"), ["Nota leit;Coment.leitura;ANÁLISE", "P111;3 4;C"])
    _write(str(d / "mvc_0003_AGO_test.csv"), ["Nota leit;Coment.leitura;ANÁLISE", "T181;5;FL"])
    df = read_training_csvs(spark, str(d / "mvc_000*_test.csv"), exclude=["AGO"])
    assert sorted(r["Nota_leit"] for r in df.collect()) == ["B111", "P111"]
    with pytest.raises(ValueError):
        read_training_csvs(spark, str(d / "mvc_000*_test.csv"), exclude=["mvc"])
    with pytest.raises(ValueError):
        read_training_csvs(spark, str(d / "nothing_*.csv"))


def test_labelled_scan(spark, tmp_path):
    p = _write(str(tmp_path / "l.csv"), ["comentario,classificacao,sigla", "a,X,", ",Y,OK", "b,,OK", "c,Z,CFP"])
    rows = sorted(tuple(r) for r in read_labelled_csv(spark, p, "comentario", "classificacao", "sigla").collect())
    assert rows == [("a", "X", None), ("c", "Z", "CFP")]


def test_streaming_audit_matches_batch(spark, tmp_path):
    from cometa.streaming.audit_stream import start_audit_stream

    src = tmp_path / "in"
    src.mkdir()
    _write(str(src / "m1.csv"), [HEADER] + ROWS)
    q = start_audit_stream(spark, str(src), str(tmp_path / "sout"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    streamed = {r["Nº_Serie"]: r[ANALYSIS] for r in spark.read.parquet(str(tmp_path / "sout")).collect()}
    batch = run_audit(spark, str(src / "m1.csv"), str(tmp_path / "bout"), analyze=False)
    assert streamed == {r["Nº_Serie"]: r[ANALYSIS] for r in batch.validated.collect()}


def test_streaming_default_checkpoint_under_shared_dir(spark, tmp_path):
    import os

    from cometa.session import ensure_checkpoint_dir
    from cometa.streaming.audit_stream import start_audit_stream

    inp = tmp_path / "in"
    inp.mkdir()
    _write(str(inp / "a.csv"), [HEADER] + ROWS)
    q = start_audit_stream(spark, str(inp), str(tmp_path / "out"))
    q.awaitTermination(120)
    # the undated row is dropped
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ROWS) - 1

    base = ensure_checkpoint_dir(spark).replace("file:", "")
    assert any(n.startswith("audit_stream_") for n in os.listdir(base))


def test_files_are_matched_by_name(spark, tmp_path):
    """Swapped, missing and extra columns, an excluded first file, and a path with a space."""
    from cometa.sources.csv_audit import read_train_and_target, read_training_csvs

    folder = tmp_path / "with space"
    folder.mkdir()
    (folder / "a AGO X.csv").write_text("A;B;C\n1;2;3\n", encoding="utf-8")
    (folder / "b.csv").write_text("Nota leit;Coment;Data\nB111;um;d1\n", encoding="utf-8")
    (folder / "c.csv").write_text("Data;Coment;Extra;Nota leit\nd2;dois;e;P111\n", encoding="utf-8")
    (folder / "d.csv").write_text("Nota leit\nP131\n", encoding="utf-8")
    df = read_training_csvs(spark, f"{folder}/*.csv", exclude=["AGO X"])
    got = {(r.Nota_leit, r.Coment, r.Data, r.Extra) for r in df.collect()}
    assert got == {("B111", "um", "d1", None), ("P111", "dois", "d2", "e"), ("P131", None, None, None)}
    with pytest.raises(ValueError):
        read_training_csvs(spark, f"{folder}/*.csv", exclude=["with space"])
    both = read_train_and_target(spark, f"{folder}/b.csv", f"{folder}/c.csv")
    assert {(r.Nota_leit, r.part) for r in both.collect()} == {("B111", "train"), ("P111", "target")}


def test_date_is_mandatory_where_asked(spark, tmp_path):
    from cometa.sources.csv_audit import read_audit_csv

    p = tmp_path / "x.csv"
    p.write_text("Nota leit;Coment\nB111;um\n", encoding="utf-8")
    assert read_audit_csv(spark, str(p)).count() == 1
    with pytest.raises(KeyError):
        read_audit_csv(spark, str(p), date_required=True)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_statistics_agree_with_quoted_newlines(spark, tmp_path, fmt):
    p = tmp_path / "q.csv"
    p.write_text('"Nota\nleit";Comentleitura;Data\nC111;"linha um\nlinha dois";d\nC111;texto;d\n', encoding="utf-8")
    run = run_audit(spark, str(p), str(tmp_path / f"out_{fmt}"), fmt=fmt)
    assert run.run_log.first()["total_rows"] == 2
    assert {r[ANALYSIS]: r["n"] for r in run.distribution.collect()} == {"C": 2}


def test_stream_equals_batch_on_a_header_with_a_newline(spark, tmp_path):
    from cometa.plans.audit_job import prepare
    from cometa.operators.validate import audit
    from cometa.sources.csv_audit import read_audit_csv
    from cometa.streaming.audit_stream import start_audit_stream

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "q.csv").write_text('"Nota\nleit";Comentleitura;Data\nC111;"um\ndois";d\nB111;x;d\n', encoding="utf-8")
    query = start_audit_stream(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.awaitTermination(120)
    df, nota, comment = prepare(read_audit_csv(spark, str(folder)))
    batch = audit(df, comment_col=comment, nota_col=nota, analysis_col=ANALYSIS)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, streamed.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))


@pytest.mark.parametrize(
    "raw,once,twice",
    [(" Nota leit ", "Nota_leit", "Nota_leit"), ("A.B\r\nC", "ABC", "ABC"), ("x \n", "x", "x"), ("\n y\n .z", "y_z", "y_z"), ("a\r b", "a_b", "a_b")],
)
def test_header_clauses(raw, once, twice):
    from cometa.sources.csv_audit import normalize_header

    assert normalize_header(raw) == once
    assert normalize_header(raw, legacy_double_strip=True) == twice


def _stream(spark, folder, **options):
    from cometa.streaming.audit_stream import start_audit_stream

    start_audit_stream(spark, f"{folder}/in", f"{folder}/out", f"{folder}/ckpt", totals_dir=f"{folder}/totals", **options).awaitTermination(120)


def _totals(spark, folder):
    from cometa.streaming.audit_stream import running_totals

    return {(r.nota, r.analise): r.n for r in running_totals(spark, f"{folder}/totals").collect()}


def _batch_totals(spark, folder):
    run = run_audit(spark, f"{folder}/in", f"{folder}/bout", analyze=False)
    return {(r[0], r[1]): r[2] for r in run.validated.groupBy(run.nota_col, ANALYSIS).count().collect()}


def test_stream_labels_two_layouts_as_the_batch_does(spark, tmp_path):
    """The columns of the second file stand in another order; by position its labels would be wrong."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("Nota_leit;Comentleitura;Data\nB111;12345 678;d\n", encoding="utf-8")
    (tmp_path / "in" / "b.csv").write_text("Comentleitura;Extra;Nota_leit;Data\n67890;e;B111;d\nnada;e;C111;d\n", encoding="utf-8")
    _stream(spark, tmp_path)
    streamed = spark.read.option("mergeSchema", True).parquet(str(tmp_path / "out"))
    got = sorted(map(tuple, streamed.select("Nota_leit", "Comentleitura", ANALYSIS).collect()))
    batch = run_audit(spark, str(tmp_path / "in"), str(tmp_path / "bout"), analyze=False).validated
    assert got == sorted(map(tuple, batch.select("Nota_leit", "Comentleitura", ANALYSIS).collect()))
    assert ("B111", "67890", "FL") in got


def test_stream_totals_survive_restarts_and_repeated_batches(spark, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    for k in range(3):
        _write(str(tmp_path / "in" / f"m{k}.csv"), [HEADER] + ROWS[: 2 + k])
    _stream(spark, tmp_path, files_per_batch=1)
    first = _totals(spark, tmp_path)
    assert first == _batch_totals(spark, tmp_path)
    # the driver is lost before it logs the last batch: the batch is run again
    last = max((tmp_path / "ckpt" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    shutil.copy(last, tmp_path / "kept")
    last.unlink()
    crc = last.with_name(f".{last.name}.crc")
    if crc.exists():
        crc.unlink()
    (tmp_path / "in" / "n.csv").write_text("Data;Nota_leit;Comentleitura\nd;C111;texto\n", encoding="utf-8")
    _stream(spark, tmp_path, files_per_batch=1)
    assert _totals(spark, tmp_path) == _batch_totals(spark, tmp_path)
    assert sum(_totals(spark, tmp_path).values()) == sum(first.values()) + 1


def test_folded_totals_equal_the_sum_of_batches(spark, tmp_path):
    from cometa.streaming.audit_stream import TOTALS, running_totals, write_totals

    want = {}
    for k in range(7):
        rows = [(f"N{k % 2}", "C", k + 1), (None, None, 1)]
        for _ in range(1 + k % 3):  # some batches are repeated
            write_totals(spark.createDataFrame(rows, TOTALS), str(tmp_path), k, fold_every=3)
        for n, a, x in rows:
            want[n, a] = want.get((n, a), 0) + x
    assert {(r.nota, r.analise): r.n for r in running_totals(spark, str(tmp_path)).collect()} == want
    assert running_totals(spark, str(tmp_path / "none")).collect() == []


def test_job_names_its_output_after_the_input(spark, tmp_path):
    _write(str(tmp_path / "m.csv"), [HEADER] + ROWS)
    run = run_audit(spark, str(tmp_path / "m.csv"), analyze=False)
    assert (tmp_path / "m_VALIDADO").is_dir() and run.validated.count() == len(ROWS) - 1
