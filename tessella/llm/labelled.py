"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def remainder(doc_id: str = "doc_id", folds: int = FOLDS):
    """The fold of a row: crc32 of the id as text, modulo the folds; fold 0 is held out. A null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds, F.lit(0))


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and y of the labelled rows outside fold 0; of repeated rows the highest label counts, nulls are left out."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder() != 0))
    return rows.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))


def sample(documents: DataFrame, labelled: DataFrame, per_class: int, columns: tuple[str, ...] = ("text",)) -> list[tuple]:
    """(y, *columns) of at most per_class documents of each label, those whose ids have the lowest hashes.

    At most 2 * per_class ids are broadcast, and at most twice that many documents reach the driver.
    """
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    ids = labelled.where("y = 1").orderBy(*order).limit(per_class).unionByName(labelled.where("y = 0").orderBy(*order).limit(per_class))
    found = documents.select("doc_id", *columns).join(F.broadcast(ids), "doc_id").select("y", *columns, "doc_id")
    rows = [tuple(r) for r in found.limit(4 * per_class).collect()]
    return [r[:-1] for r in sorted(rows, key=lambda r: (r[-1], str(r[1])))]
