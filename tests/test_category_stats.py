"""Out-of-fold class shares of categories, and the forest on them."""

import pytest
from pyspark.sql import functions as F

from cometa.operators import category_stats as cs
from cometa.operators import models


def brute(rows, folds, classes, strength):
    """{row: shares} with plain counts; rows are (category, label, fold)."""
    out = []
    for category, _, fold in rows:
        rest = [(c, y) for c, y, f in rows if y is not None and (fold == cs.ALL or f != fold)]
        prior = [sum(y == k for _, y in rest) / len(rest) if rest else 1 / len(classes) for k in classes]
        mine = [y for c, y in rest if c == category]
        out.append([(sum(y == k for y in mine) + strength * p) / (len(mine) + strength) for k, p in zip(classes, prior)])
    return out


@pytest.mark.parametrize("strength", [1.0, 10.0])
def test_shares_equal_plain_counts(spark, strength):
    rows = [(None if k % 11 == 0 else f"c{k % 7}", None if k % 5 == 0 else "xyz"[k * k % 3], k) for k in range(200)]
    rows += [("once", "x", 777), ("never labelled", None, 778)]
    df = cs.with_fold(spark.createDataFrame(rows, "c string, y string, k int"), "y", F.col("k"))
    got = cs.fit_statistics(df, ["c"], "y", strength=strength).shares(df, "fold", "s").collect()
    want = brute([(r.c, r.y, r.fold) for r in got], cs.FOLDS, ["x", "y", "z"], strength)
    assert all(abs(a - b) < 1e-12 for r, w in zip(got, want) for a, b in zip(r.s, w))
    assert len(got) == len(rows) and {r.fold for r in got if r.y is None} == {cs.ALL}
    assert {r.fold for r in got if r.y is not None} == set(range(cs.FOLDS))


def test_a_rows_own_label_is_not_in_its_shares(spark):
    """Labels that only a row's own category knows: every category occurs once, so all shares are the prior."""
    df = spark.createDataFrame([(f"c{k}", "ab"[k % 2], k) for k in range(100)], "c string, y string, k int")
    df = cs.with_fold(df, "y", F.col("k"))
    got = cs.fit_statistics(df, ["c"], "y").shares(df, "fold", "s").collect()
    by_fold = {}
    for r in got:
        by_fold.setdefault(r.fold, set()).add(tuple(r.s))
    assert all(len(v) == 1 for v in by_fold.values())


def test_empty_tables_and_one_fold(spark):
    schema = "c string, y string, k int"
    empty = cs.with_fold(spark.createDataFrame([], schema), "y", F.col("k"))
    stats = cs.fit_statistics(empty, ["c"], "y", classes=["a", "b"])
    todo = cs.with_fold(spark.createDataFrame([("q", None, 1)], schema), "y", F.col("k"))
    assert stats.shares(todo, "fold", "s").first().s == [0.5, 0.5]
    assert stats.shares(empty, "fold", "s").collect() == []
    same = spark.createDataFrame([("q", "a", 1)] * 3, schema).withColumn("fold", F.lit(0))
    assert cs.fit_statistics(same, ["c"], "y", classes=["a", "b"]).shares(same, "fold", "s").first().s == [0.5, 0.5]


def test_forest_tells_ten_thousand_comments_apart(spark):
    """Comments alternate between two labels; only their own counts tell them apart."""
    rows = spark.range(60_000).select(
        F.lit("N1").alias("nota"),
        F.concat(F.lit("comment "), (F.col("id") % 10_000).cast("string")).alias("comentario"),
        F.when(F.col("id") < 10_000, None).when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("analise"),
    )
    out = models.forest_fill(rows, "nota", "comentario", "analise", trees=10, max_depth=5).where("origin = 'filled'")
    wrong = out.where(F.when(F.regexp_extract("comentario", r"(\d+)", 1).cast("int") % 2 == 0, "even").otherwise("odd") != F.col("analise"))
    assert out.count() == 10_000 and wrong.count() < 50


def test_forest_uses_pairs_of_note_and_comment(spark):
    """The label is the exclusive or of note and comment: neither alone says anything."""
    rows = [(f"N{k % 2}", f"c{k // 2 % 100}", ["a", "b"][(k + k // 2) % 2] if k >= 200 else None) for k in range(2400)]
    df = spark.createDataFrame(rows, "nota string, comentario string, analise string")
    out = models.forest_fill(df, "nota", "comentario", "analise", trees=20, max_depth=6).where("origin = 'filled'").collect()
    assert sum(r.analise == ["a", "b"][(int(r.nota[1:]) + int(r.comentario[1:])) % 2] for r in out) >= 195


def test_trees_see_each_distinct_row_once(spark, monkeypatch):
    """Equal rows are one row to a tree, however many there are, and are predicted once."""
    rows = [(f"N{k % 3}", f"c{k % 2}", "ab"[k % 3 % 2]) for k in range(3000)] + [(f"N{k % 3}", f"c{k % 2}", None) for k in range(600)]
    df = spark.createDataFrame(rows, "nota string, comentario string, analise string")
    seen, fit = [], models.RandomForestClassifier.fit
    monkeypatch.setattr(models.RandomForestClassifier, "fit", lambda self, d, *a: seen.append(d.count()) or fit(self, d, *a))
    out = models.forest_fill(df, "nota", "comentario", "analise", trees=5, max_depth=4).collect()
    assert seen and max(seen) <= 6 * cs.FOLDS
    assert len(out) == 3600 and all(r.analise == "ab"[int(r.nota[1:]) % 2] for r in out)


def test_a_bootstrap_draws_equal_rows_as_often_as_rows_on_their_own(spark):
    """A Poisson number of the mean of the rows counted: its mean and variance are theirs; the same on a rerun."""
    df = spark.range(400).select(F.xxhash64("id").alias("key"), F.when(F.col("id") < 200, 1).otherwise(900).cast("long").alias("n"))
    draw = models._bootstrap(50, 42)
    got = sorted((r.n, r.drawn) for r in df.select("n", draw("key", "n").alias("drawn")).collect())
    assert got == sorted((r.n, r.drawn) for r in df.repartition(7).select("n", draw("key", "n").alias("drawn")).collect())
    for n in (1, 900):
        xs = [x for m, drawn in got if m == n for x in drawn]
        mean = sum(xs) / len(xs)
        assert abs(mean / n - 1) < 0.05 and abs(sum((x - mean) ** 2 for x in xs) / len(xs) / n - 1) < 0.1


def test_forest_fills_null_notes_and_comments_and_repeated_rows(spark):
    rows = [("A", None, "x")] * 20 + [(None, "c", "y")] * 20 + [("A", None, None)] * 3 + [(None, "c", None)] * 2 + [("new", "new", None), (None, None, None)]
    df = spark.createDataFrame(rows, "nota string, comentario string, analise string")
    for balanced in (False, True):
        out = models.forest_fill(df, "nota", "comentario", "analise", trees=9, max_depth=4, balanced=balanced).collect()
        filled = [r for r in out if r.origin == "filled"]
        assert len(out) == 47 and len(filled) == 7 and all(r.analise in ("x", "y") for r in filled)
        assert [r.analise for r in filled if r.nota == "A"] == ["x"] * 3 and [r.analise for r in filled if r.comentario == "c"] == ["y"] * 2
