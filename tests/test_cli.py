"""The command-line runner: parameters reach the query, rows print as JSON."""

from __future__ import annotations

import json

from conftest import SF_SMALL
from vitrine.cli import main
from vitrine.plans import QUERIES


def test_run_prints_json_rows(spark, capsys):
    assert main(["run", "q09_sales_by_payment", "--sf", SF_SMALL, "--as-of", "2001-08-01",
                 "--start", "2000-01-01", "--end", "2000-12-31", "--limit", "2"]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert len(rows) == 2 and set(rows[0]) == {"payment", "orders", "revenue"}


def test_list_names_every_query(capsys):
    assert main(["list"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert len(out) == len(QUERIES) and out[0].startswith("q01_overview_kpis")


def test_sync_and_curate_commands(spark, capsys, tmp_path):
    land_q, land_p = tmp_path / "lq", tmp_path / "lp"
    land_q.mkdir()
    land_p.mkdir()
    (land_q / "a.json").write_text(json.dumps(
        {"keys": ["2024-01-29", "q", "/p/1", "BRA", "MOBILE"], "clicks": 2, "impressions": 8,
         "ctr": 0.25, "position": 4.0}) + "\n")
    (land_p / "a.json").write_text("")
    assert main(["sync", "--landing-queries", str(land_q), "--landing-pages", str(land_p),
                 "--root", str(tmp_path / "t"), "--as-of", "2024-01-31"]) == 0
    out = json.loads(capsys.readouterr().out.strip())
    assert out == {"period": "2024-01-24 -> 2024-01-30", "search_queries": 1, "search_pages": 0}
    assert main(["curate", "--sf", SF_SMALL, "--root", str(tmp_path / "c")]) == 0
    assert main(["run", "q07_sales_kpis", "--curated", str(tmp_path / "c"), "--as-of", "2000-06-15"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["orders"] > 0


def test_curate_into_catalog(spark, capsys, tmp_path):
    assert main(["curate", "--sf", SF_SMALL, "--root", str(tmp_path / "cat"), "--catalog", "vitrine_cli"]) == 0
    assert main(["run", "q23_dead_stock", "--catalog", "vitrine_cli", "--limit", "3"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 3


def test_default_period_is_month_to_date(spark, capsys):
    assert main(["run", "q02_revenue_daily", "--sf", SF_SMALL, "--as-of", "2000-07-20"]) == 0
    days = [json.loads(x)["day"] for x in capsys.readouterr().out.splitlines()]
    assert days and min(days) >= "2000-07-01" and max(days) <= "2000-07-20"


def test_all_rows_are_printed(spark, capsys):
    assert main(["run", "j1_upsert_queries", "--sf", SF_SMALL]) == 0
    n = len(capsys.readouterr().out.splitlines())
    assert main(["run", "j1_upsert_queries", "--sf", SF_SMALL, "--max-rows", "5"]) == 0
    assert n > 5 == len(capsys.readouterr().out.splitlines())
