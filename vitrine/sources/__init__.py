"""Where tables come from: the test parquet, curated parquet, JDBC, landing JSON."""

from .tables import Tables, from_catalog, from_frames, from_parquet, from_testdata

__all__ = ["Tables", "from_catalog", "from_frames", "from_parquet", "from_testdata"]
