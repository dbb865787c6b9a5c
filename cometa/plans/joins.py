"""Joining a lookup table that is computed from a large one.

The lookup side (class list, per-class counts, vocabulary) is evaluated once and
written to the shared folder, then joined from there. Spark knows a written
table's size in bytes and broadcasts it only below its own threshold
(``spark.sql.autoBroadcastJoinThreshold``); beyond it the join is a shuffle join
whose frequent keys adaptive execution splits. There is no bound on rows, the
result is the same at every size, and nothing is collected.

Tables that grow with the data by design (one row per route, per document, ...)
should not come here at all: join them directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from cometa.session import materialize


def lookup_join(big: DataFrame, small: DataFrame, on, how: str = "left") -> DataFrame:
    """Join ``big`` with a lookup table that is evaluated once."""
    return big.join(materialize(small, "lookup"), on=on, how=how)
