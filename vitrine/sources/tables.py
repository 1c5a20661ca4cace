"""Table sets the queries run on.

A ``Tables`` object maps the ten table names to DataFrames, built lazily on
first use. Text dates get their parsed DATE column (operator O1) unless the
source already stores it (curated tables), in which case filters on it reach
the parquet scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ..functions.dates import parse_date
from ..schemas import PARSED_DATES, TABLES, curated_schema
from . import testdata


class Tables(Mapping):
    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders = dict(builders)
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            df = self._builders[name]()
            parsed = PARSED_DATES.get(name)
            if parsed and parsed[0] not in df.columns:
                df = df.withColumn(parsed[0], parse_date(parsed[1]))
            self._cache[name] = df
        return self._cache[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def from_testdata(spark: SparkSession, sf_dir: str) -> Tables:
    """The ten views over the driver's parquet tables (see FIXTURES.md)."""
    return Tables({name: (lambda f=fn: f(spark, sf_dir)) for name, fn in testdata.VIEWS.items()})


def from_parquet(spark: SparkSession, root: str, summaries: bool = True) -> Tables:
    """Tables stored as parquet folders ``<root>/<name>`` (curated copies),
    read with their explicit schemas (nothing inferred; a column a copy does
    not hold reads as NULL), and (with ``summaries``) the kept
    summaries in use there."""
    from . import kept
    root = root.rstrip("/")
    out = {name: (lambda n=name: spark.read.schema(curated_schema(n)).parquet(f"{root}/{n}")) for name in TABLES}
    for group, names in kept.GROUPS.items():
        if summaries and kept.in_use(spark, root, group):
            out |= {name: (lambda n=name: kept.read_summary(spark, root, n)) for name in names}
    return Tables(out)


def from_catalog(spark: SparkSession, database: str | None = None) -> Tables:
    """Tables registered in the session catalog (a metastore database, or
    temporary views when ``database`` is None); partition metadata and
    pruning then come from the catalog."""
    prefix = f"{database}." if database else ""
    return Tables({name: (lambda n=name: spark.table(f"{prefix}{n}")) for name in TABLES})


def from_frames(frames: Mapping[str, DataFrame]) -> Tables:
    """Tables from ready DataFrames (tests, other sources)."""
    return Tables({name: (lambda df=df: df) for name, df in frames.items()})
