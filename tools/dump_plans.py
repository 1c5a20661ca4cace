"""Write PLANS.md: the physical plan of every registered query on the curated
layout (operator tree plus the scan lines that show pruning and pushdown).

usage: python tools/dump_plans.py [sf_dir] [out.md]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vitrine.plans import QUERIES, run  # noqa: E402
from vitrine.session import get_session, scratch_dir  # noqa: E402
from vitrine.sources import from_parquet, from_testdata  # noqa: E402
from vitrine.sources.curated import write_curated  # noqa: E402

KEEP = re.compile(r"^\((\d+)\) Scan parquet|^(PartitionFilters|PushedFilters|ReadSchema):")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    out = sys.argv[2] if len(sys.argv) > 2 else "PLANS.md"
    spark = get_session("local[8]", shuffle_partitions=16, conf={"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    root = scratch_dir(spark, f"plans-{uuid.uuid4().hex[:8]}")
    write_curated(from_testdata(spark, sf_dir), root)
    t = from_parquet(spark, root)
    parts = ["# Physical plans on the curated layout\n",
             "Generated by `tools/dump_plans.py` (initial adaptive plans; AQE may still switch a "
             "sort-merge join to a broadcast join or coalesce partitions at runtime). Scan lines show "
             "partition pruning, pushed filters and the pruned read schema.\n"]
    for name in QUERIES:
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            run(name, t).explain("formatted")
        text = buf.getvalue()
        tree, details = text.split("\n\n", 1) if "\n\n" in text else (text, "")
        scans = [ln for ln in details.splitlines() if KEEP.match(ln)]
        parts.append(f"## {name}\n\n```\n{tree.strip()}\n" + ("\n" + "\n".join(scans) if scans else "")
                     + "\n```\n")
    with open(out, "w") as f:
        f.write("\n".join(parts))


if __name__ == "__main__":
    main()
