"""What the labels of a category's other rows say about it.

A category with very many values (a free-text comment) can't be a category code to
a tree: it would need a bin a value. Instead each row gets, for every class, the
share of that class among the *other* rows of its category, so that its own label
never reaches its features:

* labelled rows are dealt into folds; a row of fold f sees its category's counts
  without fold f's rows;
* rows without a label see all counts;
* shares are smoothed towards the class's share outside the fold,
  ``(n_c + strength * prior_c) / (n + strength)``, so a category seen nowhere else
  has the prior and a frequent one nearly its own shares.

Scale: one aggregation of (category, fold, class), partial in each task; a category
that a third of all rows share costs one row a fold and class. The counts are joined
back from a written table, which Spark broadcasts when it is small, and otherwise
joins by shuffle, splitting hot categories at run time. Nothing is collected but
the class list. Null is a category of its own.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cometa.session import materialize

FOLDS = 5
STRENGTH = 10.0
ALL = -1  # the fold of rows to predict: no row is left out


def fold_of(key: Column, folds: int = FOLDS) -> Column:
    """The fold of a labelled row by its key: the first 32 bits of the key's MD5, modulo ``folds``."""
    return (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % folds).cast("int")


class CategoryStatistics:
    """Counts of (category, fold, class), from which shares are derived.

    ``keys`` are the columns that make a category, ``fold`` the column of the fold,
    ``classes`` the class list in the order of the shares.
    """

    def __init__(self, counts: DataFrame, keys: list[str], classes: list[str], strength: float = STRENGTH) -> None:
        self.keys, self.classes, self.strength = keys, classes, strength
        n = F.col("__n")
        per = [F.coalesce(F.sum(F.when(F.col("__c") == c, n)), F.lit(0)).alias(f"__n{j}") for j, c in enumerate(classes)]
        folds = {r["__f"]: list(r)[1:] for r in counts.groupBy("__f").agg(*per).collect()}  # a row a fold
        sums = [sum(x) for x in zip(*folds.values())] or [0] * len(classes)
        self.prior = {}
        for fold, mine in {ALL: [0] * len(classes), **folds}.items():
            rest = [a - b for a, b in zip(sums, mine)]
            total = sum(rest)
            self.prior[fold] = [x / total if total else 1 / len(classes) for x in rest]
        # a row a category with its count of each fold and class, then one for each fold that it has and for all
        held = [F.coalesce(F.sum(F.when((F.col("__f") == f) & (F.col("__c") == c), n)), F.lit(0)).alias(f"__n{i}_{j}") for i, f in enumerate(folds) for j, c in enumerate(classes)]
        wide = counts.groupBy(*keys).agg(F.sum("__n").alias("__every"), *held)
        own = {f: [F.col(f"__n{i}_{j}") for j in range(len(classes))] for i, f in enumerate(folds)}
        every = [reduce(add, x) for x in zip(*own.values())]
        entries = [F.struct(F.lit(ALL).alias("__f"), self._smooth(every, F.col("__every"), ALL).alias("__share"))]
        for f, mine in own.items():
            size = reduce(add, mine)
            share = self._smooth([a - b for a, b in zip(every, mine)], F.col("__every") - size, f)
            entries.append(F.when(size > 0, F.struct(F.lit(f).alias("__f"), share.alias("__share"))))
        table = wide.select(*keys, F.explode(F.array(*entries)).alias("__entry")).where(F.col("__entry").isNotNull())
        self.table = materialize(table.select(*keys, "__entry.__f", "__entry.__share"), "category_shares")

    def _smooth(self, left: list[Column], total: Column, fold: int) -> Column:
        return F.array(*[(n + F.lit(self.strength * p)) / (total + F.lit(self.strength)) for n, p in zip(left, self.prior[fold])])

    def shares(self, df: DataFrame, fold: str, out: str) -> DataFrame:
        """``df`` with ``out``: the smoothed share of each class in the row's category, outside its fold."""
        right = self.table.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)], "__f", "__share")
        same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(self.keys)]
        joined = df.join(right, [*same, F.col(fold) == F.col("__f")], "left").drop(*[f"__k{i}" for i in range(len(self.keys))], "__f")
        # a category seen nowhere else; a fold that no labelled row has is like none left out
        unseen = {f: [(0 + self.strength * v) / (0 + self.strength) for v in p] for f, p in self.prior.items()}
        known = F.coalesce("__share", F.element_at(_by_fold(unseen), F.col(fold)), F.array(*[F.lit(v) for v in unseen[ALL]]))
        return joined.withColumn(out, known).drop("__share")


def _by_fold(values: dict[int, list[float]]) -> Column:
    return F.create_map(*[x for f, p in values.items() for x in (F.lit(f), F.array(*[F.lit(v) for v in p]))])


def with_fold(df: DataFrame, label: str, key: Column, folds: int = FOLDS, out: str = "fold") -> DataFrame:
    """``df`` with the fold of each labelled row, and ``ALL`` for rows to predict."""
    return df.withColumn(out, F.when(F.col(label).isNull(), ALL).otherwise(fold_of(key, folds)))


def fit_statistics(df: DataFrame, keys: list[str], label: str, fold: str = "fold", classes: list[str] | None = None, strength: float = STRENGTH, rows: str | None = None) -> CategoryStatistics:
    """The statistics of the labelled rows of ``df``; runs the aggregation.
    ``rows``: the column of how many rows a row of ``df`` stands for, if it was counted before."""
    known = df.where(F.col(label).isNotNull())
    n = F.count(F.lit(1)) if rows is None else F.sum(F.col(rows))
    counts = known.groupBy(*keys, F.col(fold).alias("__f"), F.col(label).alias("__c")).agg(n.alias("__n"))
    counts = materialize(counts, "category_class_counts")
    if classes is None:
        classes = [r[0] for r in counts.select("__c").distinct().orderBy("__c").collect()]
    return CategoryStatistics(counts, keys, classes, strength)
