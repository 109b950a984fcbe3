"""The line model shared by link extraction, quality scoring and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions.text import let, zipped


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def lines(topics: DataFrame, text: str = "text") -> DataFrame:
    """``path, line_no, line``: an explode, no shuffle."""
    rows = topics.select("path", F.posexplode(split_lines(F.col(text))).alias("pos", "line"))
    return rows.select("path", (F.col("pos") + 1).alias("line_no"), "line")


def lines_with_context(topics: DataFrame, text: str = "text", ahead: int = 1) -> DataFrame:
    """Lines with ``prev`` and ``next1..n`` taken from the same array.

    Neighbours come from shifted copies of the line array inside the row, so rules
    that look a fixed number of lines around need neither a window nor a shuffle.
    Missing neighbours are null.
    """
    names = ["line", "prev"] + [f"next{k}" for k in range(1, ahead + 1)]
    none = F.array(F.lit(None).cast("string"))

    def shifted(arr):
        before = F.concat(none, F.slice(arr, F.lit(1), F.size(arr) - 1))
        after = [
            F.slice(arr, F.lit(k + 1), F.greatest(F.size(arr) - k, F.lit(0))) for k in range(1, ahead + 1)
        ]
        return zipped({n: "string" for n in names}, arr, before, *after)

    rows = topics.select("path", F.posexplode(let(split_lines(F.col(text)), shifted)).alias("pos", "z"))
    return rows.select("path", (F.col("pos") + 1).alias("line_no"), *[F.col("z")[n].alias(n) for n in names])


def repeated(entries: Column) -> Column:
    """Entries of ``array<struct<key, n>>`` that repeat the key before them in sort order.

    Sorting inside the row keeps the work n log n and local to the topic.
    """

    def again(ordered):
        before = F.concat(F.array(F.lit(None).cast("string")), F.transform(ordered, lambda e: e["key"]))
        flagged = F.zip_with(
            ordered,
            F.slice(before, F.lit(1), F.size(ordered)),
            lambda e, p: F.struct(e["key"].alias("key"), e["n"].alias("n"), (e["key"] == p).alias("again")),
        )
        hits = F.filter(flagged, lambda x: F.coalesce(x["again"], F.lit(False)))
        return F.transform(hits, lambda x: F.struct(x["key"].alias("key"), x["n"].alias("n")))

    return let(F.array_sort(entries), again)
