"""Pages: the directories of files in order, selected, sorted, joined end to end and taken out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def count_pages(pages: DataFrame, keys: list[str]) -> DataFrame:
    return pages.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pages"))


def select_pages(pages: DataFrame, page: str, numbers: list[int] | None = None, first: int | None = None) -> DataFrame:
    """The pages of a list, or from `first` on."""
    return pages.where(F.col(page).isin(numbers) if numbers is not None else F.col(page) >= (first or 0))


def unlink_page(pages: DataFrame, unlinked: DataFrame, keys: list[str], page: str, out: str = "new_page") -> DataFrame:
    """All pages but the unlinked ones, numbered anew from 0."""
    left = pages.join(unlinked, [*keys, page], "left_anti")
    return left.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(page)).cast("long") - 1)


def sort_pages(pages: DataFrame, keys: list[str], number: str, directory: str, out: str = "position") -> DataFrame:
    """Positions of the pages by page number, ties by directory."""
    return pages.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(number, directory)).cast("long") - 1)


def concat_pages(inputs: list[DataFrame]) -> DataFrame:
    """All pages of several inputs, with the input's place as input_pos."""
    out = inputs[0].withColumn("input_pos", F.lit(0).cast("long"))
    for i, other in enumerate(inputs[1:], 1):
        out = out.unionByName(other.withColumn("input_pos", F.lit(i).cast("long")))
    return out


def pdf_pages(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Page order for a PDF: pages with a page number (its total, if smaller and not 0), else those marked as pages, by number and directory.

    Takes page_number, page_total, subfile_type (each may be null) and ifd.
    """
    numbered = F.col("page_number").isNotNull()
    chosen = pages.where(numbered | F.coalesce(F.col("subfile_type").bitwiseAND(2) != 0, F.lit(False)) | F.coalesce(F.col("subfile_type") == 0, F.lit(True)))
    number = F.when(numbered, F.when((F.col("page_number") > F.col("page_total")) & (F.col("page_total") != 0), F.col("page_total")).otherwise(F.col("page_number"))).otherwise(F.lit(0))
    return sort_pages(chosen.withColumn("sort_number", number), keys, "sort_number", "ifd")
