"""Run any dashboard query from the command line and print JSON rows.

    python -m vitrine list
    python -m vitrine run q08_sales_by_channel --sf /root/testdata/sf0.01 --start 2000-01-01 --end 2000-12-31
    python -m vitrine run q19_product_abc --curated /data/shop --as-of 2024-05-17
    python -m vitrine curate --sf /root/testdata/sf0.1 --root /data/shop [--refresh-start D --refresh-end D]
    python -m vitrine curate --sf /root/testdata/sf0.1 --root /data/shop --catalog shop   (bucketed layout)
    python -m vitrine curate --jdbc jdbc:postgresql://HOST/DB --jdbc-option user=U --jdbc-bounds sales=1:900000 --root /data/shop
    python -m vitrine pull --jdbc jdbc:postgresql://HOST/DB --jdbc-option user=U --root /data/shop   (changed sales since the last pull)
    python -m vitrine sync --landing-queries L1 --landing-pages L2 --root /data/shop --as-of D [--days 7]

The parameters are the dashboard's: a period (--start/--end, month to date
of --as-of when omitted; --as-of is today when omitted), --limit, --years,
--days, --months. A query takes the ones it declares; the others are ignored.
All rows are printed, one partition at a time; --max-rows prints fewer.
"""

from __future__ import annotations

import argparse
import datetime as dt
import inspect
import json
import sys

from pyspark.sql import functions as F

from .plans import QUERIES
from .session import get_session
from .sources import from_catalog, from_parquet, from_testdata


def _params(fn, args) -> dict:
    accepted = inspect.signature(fn).parameters
    given = {
        "as_of": dt.date.fromisoformat(args.as_of) if args.as_of else None,
        "period": (args.start, args.end) if (args.start or args.end) else None,
        "limit": args.limit, "years": args.years, "days": args.days, "months": args.months,
    }
    return {k: v for k, v in given.items() if k in accepted and v is not None}


def _jdbc_source(spark, args):
    from .sources.jdbc import from_jdbc
    properties = dict(item.split("=", 1) for item in args.jdbc_option)
    bounds = {name: tuple(span.split(":", 1)) for name, span in (item.split("=", 1) for item in args.jdbc_bounds)}
    return from_jdbc(spark, args.jdbc, properties, bounds, args.jdbc_partitions, snapshot=args.snapshot)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="vitrine")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="registered queries")
    run_p = sub.add_parser("run", help="run one query")
    run_p.add_argument("name", choices=sorted(QUERIES))
    src = run_p.add_mutually_exclusive_group()
    src.add_argument("--sf", default="/root/testdata/sf0.01", help="TPC-H-like parquet folder")
    src.add_argument("--curated", help="root of curated parquet tables")
    src.add_argument("--catalog", help="catalog database holding the tables")
    run_p.add_argument("--as-of", dest="as_of")
    run_p.add_argument("--start")
    run_p.add_argument("--end")
    run_p.add_argument("--limit", type=int)
    run_p.add_argument("--years", type=int)
    run_p.add_argument("--days", type=int)
    run_p.add_argument("--months", type=int)
    run_p.add_argument("--max-rows", type=int, help="print at most so many rows (default: all)")
    run_p.add_argument("--master")
    cur_p = sub.add_parser("curate", help="load step: write the curated tables")
    cur_src = cur_p.add_mutually_exclusive_group(required=True)
    cur_src.add_argument("--sf", help="TPC-H-like parquet folder")
    cur_src.add_argument("--jdbc", help="JDBC URL of the operational database")
    cur_p.add_argument("--jdbc-option", action="append", default=[], metavar="KEY=VALUE",
                       help="connection property (user, password, driver, ...)")
    cur_p.add_argument("--jdbc-bounds", action="append", default=[], metavar="TABLE=LOW:HIGH",
                       help="range-split this table's read (else it is split by row hash)")
    cur_p.add_argument("--jdbc-partitions", type=int, default=64)
    cur_p.add_argument("--root", required=True)
    cur_p.add_argument("--catalog", help="also register the tables in this catalog database, "
                                         "products and lines bucketed by sku")
    cur_p.add_argument("--refresh-start")
    cur_p.add_argument("--refresh-end")
    cur_p.add_argument("--master")
    cur_p.add_argument("--snapshot", help="id of an exported snapshot that all reads share")
    pull_p = sub.add_parser("pull", help="bring the curated sales and lines up to date")
    pull_src = pull_p.add_mutually_exclusive_group(required=True)
    pull_src.add_argument("--sf", help="TPC-H-like parquet folder")
    pull_src.add_argument("--jdbc", help="JDBC URL of the operational database")
    pull_p.add_argument("--jdbc-option", action="append", default=[], metavar="KEY=VALUE")
    pull_p.add_argument("--jdbc-partitions", type=int, default=64)
    pull_p.add_argument("--snapshot", help="id of an exported snapshot that all reads share")
    pull_p.add_argument("--overlap-minutes", type=int, default=60)
    pull_p.add_argument("--keep-deleted", action="store_true", help="do not look for deleted sales")
    pull_p.add_argument("--root", required=True)
    pull_p.add_argument("--master")
    sync_p = sub.add_parser("sync", help="upsert landed search statistics (J1-J3)")
    sync_p.add_argument("--landing-queries", required=True)
    sync_p.add_argument("--landing-pages", required=True)
    sync_p.add_argument("--root", required=True)
    sync_p.add_argument("--quarantine", help="folder for broken landing rows (else one fails the run)")
    sync_p.add_argument("--as-of", dest="as_of", default=dt.date.today().isoformat())
    sync_p.add_argument("--days", type=int, default=7)
    sync_p.add_argument("--start")
    sync_p.add_argument("--end")
    sync_p.add_argument("--master")
    args = parser.parse_args(argv)
    if args.command == "curate" and args.catalog and (args.refresh_start or args.refresh_end):
        parser.error("the catalog layout is written whole: no --refresh-start or --refresh-end with --catalog")

    if args.command == "list":
        for name, (fn, defaults) in QUERIES.items():
            print(f"{name}\t{(fn.__doc__ or '').strip().splitlines()[0]}")
        return 0

    spark = get_session(args.master)
    spark.sparkContext.setLogLevel("ERROR")
    if args.command == "curate":
        from .operators.period import Period
        from .sources.curated import write_curated
        refresh = None
        if args.refresh_start or args.refresh_end:
            start = dt.date.fromisoformat(args.refresh_start or args.refresh_end)
            refresh = Period(start, dt.date.fromisoformat(args.refresh_end or args.refresh_start))
        source = _jdbc_source(spark, args) if args.jdbc else from_testdata(spark, args.sf)
        if args.catalog:
            from .sources.curated import write_catalog
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {args.catalog}")
            write_catalog(source, args.catalog, args.root)
        else:
            write_curated(source, args.root, refresh=refresh)
        return 0
    if args.command == "pull":
        from .sources.jdbc import JdbcChanges
        from .sources.pull import FrameChanges, pull_sales
        if args.jdbc:
            properties = dict(item.split("=", 1) for item in args.jdbc_option)
            source = JdbcChanges(spark, args.jdbc, properties, args.jdbc_partitions, args.snapshot)
        else:
            source = FrameChanges(from_testdata(spark, args.sf))
        out = pull_sales(spark, source, args.root, dt.timedelta(minutes=args.overlap_minutes), not args.keep_deleted)
        sys.stdout.write(json.dumps(out) + "\n")
        return 0
    if args.command == "sync":
        from .streaming.upsert import sync_search
        out = sync_search(spark, args.landing_queries, args.landing_pages, args.root,
                          dt.date.fromisoformat(args.as_of), args.days, args.start, args.end,
                          quarantine_root=args.quarantine)
        sys.stdout.write(json.dumps(out) + "\n")
        return 0
    if args.catalog:
        tables = from_catalog(spark, args.catalog)
    elif args.curated:
        tables = from_parquet(spark, args.curated)
    else:
        tables = from_testdata(spark, args.sf)
    fn, defaults = QUERIES[args.name]
    # of the registry's test parameters only those that name the query's variant hold here
    variant = {k: v for k, v in defaults.items() if k not in ("as_of", "period")}
    params = {**variant, **_params(fn, args)}
    if "as_of" in inspect.signature(fn).parameters:
        params.setdefault("as_of", dt.date.today())
    df = fn(tables, **params)
    if args.max_rows is not None:
        df = df.limit(args.max_rows)
    for row in df.select(F.to_json(F.struct("*")).alias("row")).toLocalIterator():
        sys.stdout.write(json.dumps(json.loads(row[0]), ensure_ascii=False) + "\n")
    return 0
