"""Bulk changes whose work follows the batch, not the table.

``apply`` runs a rule of ``operators.changes`` on a ``BucketTable``:

1. One pass over the batch finds the buckets of its keys, in the table and in
   each parent.
2. Only these buckets are opened. Of a parent, only the rows whose key the
   batch names go on to the rule.
3. Of the touched buckets, the rows that the batch names go through the rule;
   the others are carried over as they are. The batch's keys are broadcast
   for that while there are at most ``BROADCAST_MAX_KEYS`` changes, which the
   first pass has counted; a larger batch meets its buckets by a shuffled join.
4. The touched buckets are written anew and committed by the manifest.

Defined results: those of the rule. An empty batch commits nothing. A batch
with a null key is rejected or "not found", as the rule says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.buckets import BucketTable
from .changes import Changed
from .joins import BROADCAST_MAX_KEYS


def _named(table: BucketTable, keys: DataFrame) -> tuple[list[int], DataFrame]:
    """(buckets, distinct keys) of the one-column frame ``keys``; the keys are
    hinted for a broadcast when they are counted to be few."""
    keys = keys.select(F.col(keys.columns[0]).cast(table.schema[table.key].dataType).alias(table.key))
    sizes = keys.groupBy(table.bucket_of(F.col(table.key)).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    distinct = keys.dropna().distinct()
    few = sum(r.n for r in sizes) <= BROADCAST_MAX_KEYS
    return sorted(r.b for r in sizes), F.broadcast(distinct) if few else distinct


def apply(table: BucketTable, batch: DataFrame, key: Column | str, rule: Callable[..., Changed],
          parents: list[tuple[BucketTable, str | Callable[[DataFrame, DataFrame], DataFrame]]] = ()) -> Changed:
    """Apply ``rule(rows, batch, *parent rows)`` to the rows that ``batch`` names by
    ``key`` and commit the result.

    A parent is (its table, the batch's column that names its keys, or a
    function of the batch and the named rows that gives these keys). The
    returned ``next`` is the table after the batch."""
    key = F.col(key) if isinstance(key, str) else key
    buckets, keys = _named(table, batch.select(key.alias(table.key)))
    if not buckets:
        nothing = rule(table.read([]), batch, *[p.read([]) for p, _ in parents])
        return Changed(table.read(), nothing.rejects, nothing.accepted)
    touched = table.read(buckets)
    rows, others = (touched.join(keys, table.key, how) for how in ("left_semi", "left_anti"))
    found = []
    for parent, names in parents:
        wanted = batch.select(names) if isinstance(names, str) else names(batch, rows)
        at, named = _named(parent, wanted)
        found.append(parent.read(at).join(named, parent.key, "left_semi"))
    changed = rule(rows, batch, *found)
    table.replace(others.unionByName(changed.next), buckets)
    return Changed(table.read(), changed.rejects, changed.accepted)


def loan_customers(batch: DataFrame, loans: DataFrame) -> DataFrame:
    """Customers that loan updates name, or that the stored loans name for them."""
    return batch.select("customer_id").unionByName(loans.select("customer_id")).distinct()
