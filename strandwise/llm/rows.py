"""Telling rows apart by id, taking them out of a table or repeating them, without moving the table where the ids are few."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import written

#: Ids (of 8 or 16 bytes) up to this number are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _small(ids: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= limit else ids


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``docs`` has."""
    while name in docs.columns:
        name += "_"
    return name


def told_apart(docs: DataFrame, doc_id: str = "doc_id", nulls_first: bool = True) -> tuple[DataFrame, str]:
    """The rows and the name of a column that has another value in each of them, and sorts them as their ids do.

    That is the id itself, unless rows repeat one or have none; then the table is sorted by id (rows
    without one first or last) and a hash of the row, numbered and written with the numbers. Rows alike
    in both are the same row, so that reruns decide alike.
    """
    ids = docs.select(F.col(doc_id).alias("id"))
    if ids.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        return docs, doc_id
    name = fresh(docs, "row number")
    whole = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() != "map"])
    order = F.col(doc_id).asc_nulls_first() if nulls_first else F.col(doc_id).asc_nulls_last()
    return written(docs.orderBy(order, whole).withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def without(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows whose id isn't in ``ids`` (one column of its own name). Rows without an id stay."""
    gone = _small(written(ids.toDF("gone").where("gone is not null").distinct(), "gone"), limit)
    return docs.join(gone, docs[doc_id] == gone["gone"], "left_anti")


def once(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Of rows that repeat an id of ``ids`` and a text, one; all other rows as they are."""
    again = written(ids.toDF("again").where("again is not null").distinct(), "again")
    if again.isEmpty():
        return docs
    again = _small(again, limit)
    same = docs[doc_id] == again["again"]
    return docs.join(again, same, "left_anti").unionByName(docs.join(again, same, "left_semi").dropDuplicates([doc_id, text]))


def repeated(docs: DataFrame, copies: DataFrame, doc_id: str = "doc_id", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Each row as often as ``copies`` (id, number, and what else belongs to the id) says, with the other columns of
    ``copies`` and, as the last one, which of its copies a row is (from 1); rows without an entry go."""
    key, number, *others = copies.columns
    times = copies.withColumnsRenamed({key: "times_id", number: "times"}).where("times > 0")
    times = _small(written(times, "times"), limit)
    joined = docs.join(times, docs[doc_id].eqNullSafe(times["times_id"]))
    each = F.explode(F.sequence(F.lit(1).cast("long"), times["times"]))
    return joined.select(*[docs[c] for c in docs.columns], *[times[c] for c in others], each.alias(fresh(docs, "nth")))
