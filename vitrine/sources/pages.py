"""Landed pages of the search API, with a completeness check.

A pull asks for pages of ``row_limit`` rows, from row 0 on, until a page is empty
or short. Each page is landed as one JSON file ``{"startRow": n, "rows": [...]}``.
A folder is one pull. It is whole if its pages start at 0, row_limit, 2 *
row_limit and so on without a gap or repetition, and every page but the last
is full. That is decided from the page sizes by one aggregate (no row is moved,
no order needed): a missing page, a short page before the last, or a full last
page, after which another was due, raises.

Spark reads the files itself, one page a task at least (a page is bounded by the
API's limit), so any store Spark can read will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import LANDING

ROW_LIMIT = 25_000        # fixed value: rows of a full page
PAGE = T.StructType([T.StructField("startRow", T.LongType()), T.StructField("rows", T.ArrayType(LANDING))])


class IncompletePull(ValueError):
    """A folder of landed pages is not one whole pull."""


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PAGE).option("multiLine", "true").option("mode", "FAILFAST").json(folder)


def check_pages(pages: DataFrame, row_limit: int = ROW_LIMIT) -> int:
    """Rows of the pull; raises if pages are missing, repeated or cut short."""
    n, start = F.coalesce(F.size("rows"), F.lit(0)), F.col("startRow")
    last = F.max_by(F.struct(n.alias("n"), start.alias("start")), start)
    got = pages.agg(
        F.count(F.lit(1)).alias("pages"), F.count_distinct(start).alias("starts"), last.alias("last"),
        F.count_if(start.isNull() | (start % row_limit != 0) | (n > row_limit)).alias("odd"),
        F.count_if(n < row_limit).alias("short"), F.coalesce(F.sum(n), F.lit(0)).alias("rows")).first()
    if not got["pages"]:
        raise IncompletePull("no page was landed")
    end = got["last"]
    problems = []
    if got["odd"]:
        problems.append(f"{got['odd']} pages without a valid start row or size")
    elif got["pages"] != got["starts"]:
        problems.append("a page was landed twice")
    elif end["start"] // row_limit + 1 != got["pages"]:
        problems.append(f"{end['start'] // row_limit + 1 - got['pages']} pages are missing before row {end['start']}")
    elif got["short"] > 1:
        problems.append("a page before the last is short")
    elif end["n"] == row_limit:
        problems.append(f"the last page is full, so one from row {end['start'] + row_limit} was due")
    if problems:
        raise IncompletePull("; ".join(problems))
    return got["rows"]


def read_pages(spark: SparkSession, folder: str, row_limit: int = ROW_LIMIT) -> DataFrame:
    """Landing rows of a whole pull, with their file's time and name."""
    pages = _pages(spark, folder)
    check_pages(pages, row_limit)
    return pages.select(F.explode("rows").alias("row"), F.col("_metadata.file_modification_time").alias("pulled_at"),
                        F.col("_metadata.file_path").alias("pulled_from")).select("row.*", "pulled_at", "pulled_from")


def land_pages(rows: DataFrame, order: list[str], folder: str, row_limit: int = ROW_LIMIT) -> None:
    """Write landing rows as a pull would land them: numbered by the unique
    ``order``, one file a page of ``row_limit`` rows, the last one short or empty."""
    from .kept import number_rows
    numbered = number_rows(rows, order, F.lit(0), "_n")
    first = ((F.col("_n") - 1) / row_limit).cast("long") * row_limit
    pages = numbered.select(first.alias("startRow"), "_n", F.struct(*LANDING.names).alias("row")).groupBy("startRow") \
        .agg(F.array_sort(F.collect_list(F.struct("_n", "row"))).alias("rows"))          # bounded by the page
    whole = pages.select("startRow", F.col("rows.row").alias("rows"))
    end = rows.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") % row_limit == 0) \
        .select(F.col("n").alias("startRow"), F.lit(None).cast(PAGE["rows"].dataType).alias("rows"))
    out = whole.select(F.col("startRow"), F.col("rows").cast(PAGE["rows"].dataType).alias("rows")).unionByName(end)
    out.select(F.to_json(F.struct("startRow", F.coalesce("rows", F.array().cast(PAGE["rows"].dataType)).alias("rows"))).alias("value"),
               F.col("startRow").alias("page")) \
        .repartition("page").write.partitionBy("page").text(folder)
