"""The ten shop/search tables derived from the driver's TPC-H-like parquet.

Each view is a plain DataFrame transformation of the base tables (joins,
projections, one aggregation for the search tables), so its work grows with
the input. The base tables hold no NULLs, empty strings or mixed date
layouts; the key-modulo rules below put those in, deterministically.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import MONEY

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events")


def read_base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def _dmy(c: Column) -> Column:
    return F.date_format(c, "dd/MM/yyyy")


def _txt(c: Column) -> Column:
    return c.cast("string")


def _dec(c: Column) -> Column:
    return c.cast(MONEY)


def _null_s() -> Column:
    return F.lit(None).cast("string")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_base(spark, sf_dir, "orders")
    c = read_base(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = read_base(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = (o.join(c, o.o_custkey == c.c_custkey)
          .join(n, F.col("c_nationkey") == F.col("n_nationkey")))
    k = F.col("o_orderkey")
    od = F.col("o_orderdate")
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    total = _dec(F.col("o_totalprice"))
    return j.select(
        k.alias("sale_id"),
        _txt(k).alias("sale_number"),
        F.when(k % 3 == 0, _txt(k)).otherwise(F.lit("")).alias("marketplace_number"),
        F.when((k % 50 == 7) & (od < F.lit("2001-06-01").cast("date")), F.lit(None).cast("bigint")).otherwise(F.col("o_custkey")).alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.when(k % 101 == 0, F.lit("")).when(k % 409 == 3, F.lit("31/02/2000"))
         .when(k % 4 == 0, _dmy(od)).otherwise(_iso(od)).alias("sale_date_text"),
        F.when(k % 211 == 5, _null_s())
         .when((st == "P") & (pr == "5-LOW"), F.lit("Cancelado"))
         .when((st == "P") & (pr == "2-HIGH"), F.lit("Cancelada"))
         .when(st == "F", F.lit("Entregue"))
         .otherwise(F.lit("Aprovado")).alias("status"),
        total.alias("total"),
        _dec(total * F.lit(Decimal("0.95"))).alias("products_total"),
        _dec(k % 37).alias("freight"),
        F.when(k % 17 == 0, F.lit(None).cast(MONEY)).otherwise(_dec(k % 13)).alias("discount"),
        F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, _null_s())
         .otherwise(F.col("c_mktsegment")).alias("channel"),
        F.when(k % 10 == 0, F.lit("")).otherwise(F.lit("Marketplace")).alias("marketplace"),
        F.when(k % 3 == 0, F.lit("")).otherwise(pr).alias("payment_method"),
        F.when(k % 6 == 0, _null_s()).otherwise(F.lit("boleto")).alias("payment_form"),
        F.when(k % 9 == 0, F.lit("")).otherwise(pr).alias("ship_method"),
        F.when(F.col("o_custkey") % 31 == 0, F.lit("")).otherwise(F.col("n_name")).alias("state"),
        F.concat(_iso(od), F.lit(" "), F.lpad(_txt(k % 24), 2, "0"), F.lit(":30:00")).alias("synced_at_text"),
    )


def sale_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_base(spark, sf_dir, "lineitem")
    p = read_base(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.select(
        F.col("l_orderkey").alias("sale_id"),
        _txt(F.col("l_partkey")).alias("sku"),
        F.concat(F.col("p_name"), F.lit(" #"), _txt(F.col("l_partkey") % 200)).alias("description"),
        _dec(F.col("l_quantity")).alias("quantity"),
        _dec(F.col("l_extendedprice")).alias("line_total"),
        _dec(F.col("p_retailprice")).alias("unit_price"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_base(spark, sf_dir, "part")
    k = F.col("p_partkey")
    price = _dec(F.col("p_retailprice"))
    return p.select(
        F.when(k % 97 == 0, F.concat(F.lit("X"), _txt(k))).otherwise(_txt(k)).alias("sku"),
        F.concat(F.col("p_name"), F.lit(" #"), _txt(k)).alias("name"),
        F.when(F.col("p_type") == "SMALL", F.lit("Inativo")).otherwise(F.lit("Ativo")).alias("status"),
        F.when(k % 11 == 0, F.lit(None).cast("int")).otherwise(F.col("p_size") - 5).cast("int").alias("stock"),
        price.alias("price"),
        F.when(k % 13 == 0, _dec(F.lit(0)))
         .when(k % 17 == 0, F.lit(None).cast(MONEY))
         .otherwise(_dec(price * F.lit(Decimal("0.6")))).alias("cost"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_base(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    created = F.date_add(F.lit("1999-01-01").cast("date"), (k % 900).cast("int"))
    return c.select(
        k.alias("customer_id"),
        F.when(k % 71 == 0, F.lit("")).when(k % 83 == 5, F.lit("2000-02-30")).when(k % 3 == 0, _dmy(created))
         .otherwise(_iso(created)).alias("created_text"),
    )


def payables(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_base(spark, sf_dir, "lineitem")
    k, sd = F.col("l_orderkey"), F.col("l_shipdate")
    amount = _dec(F.col("l_extendedprice"))
    return li.select(
        F.when(k % 19 == 0, F.lit("")).otherwise(F.substring(_iso(sd), 1, 7)).alias("period_label"),
        F.when(k % 4 == 0, _dmy(sd)).otherwise(_iso(sd)).alias("due_date_text"),
        amount.alias("amount"),
        F.when(F.col("l_linestatus") == "O", amount).otherwise(_dec(F.lit(0))).alias("balance"),
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_base(spark, sf_dir, "lineitem")
    k, sd = F.col("l_orderkey"), F.col("l_shipdate")
    m = k % 6
    return li.select(
        F.concat(F.lit("BR"), F.concat_ws("-", k, "l_linenumber", "l_partkey", "l_suppkey")).alias("tracking_code"),
        F.when(k % 41 == 0, F.lit(-1).cast("bigint")).otherwise(k).alias("sale_id"),
        F.when(m == 0, F.lit("Objeto ENTREGUE ao destinatário"))
         .when(m == 1, F.lit("Objeto saiu para entrega"))
         .when(m == 2, F.lit("OBJETO EM TRÂNSITO"))
         .when(m == 3, F.lit("Objeto postado"))
         .when(m == 4, _null_s())
         .otherwise(F.lit("em transito")).alias("status_text"),
        F.when(k % 25 == 0, _null_s()).otherwise(_iso(sd)).alias("last_checked"),
        F.when(F.col("l_linestatus") == "F", F.lit(1)).otherwise(F.lit(0)).alias("delivered"),
        _iso(F.date_add(sd.cast("date"), 7)).alias("due_date"),
        F.substring(_iso(sd), 1, 7).alias("ship_form"),
    )


def _events(spark: SparkSession, sf_dir: str, event_type: str) -> DataFrame:
    return read_base(spark, sf_dir, "events").where(F.col("event_type") == event_type)


def _months_back(months: str) -> Column:
    return F.expr(f"ts - make_ym_interval(0, cast({months} as int))")


def subscription_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, "purchase")
    k = F.col("event_id")
    return e.select(
        k.alias("event_id"),
        F.when(k % 23 == 0, F.lit("")).when(k % 29 == 0, _null_s())
         .otherwise(F.date_format(_months_back("event_id % 29 + if(event_id % 13 = 0, 265, 0)"), "yyyy-MM-dd HH:mm:ss"))
         .alias("confirmed_at_text"),
        _dec(F.col("value")).alias("net_amount"),
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, "signup")
    k = F.col("event_id")
    return e.select(
        k.alias("event_id"),
        F.when(k % 23 == 0, F.lit(""))
         .otherwise(F.date_format(_months_back("event_id % 31"), "yyyy-MM-dd HH:mm:ss")).alias("started_at_text"),
        F.when(k % 3 == 0, F.lit("canceled")).otherwise(F.lit("active")).alias("last_status"),
    )


def _search_keys(e: DataFrame) -> DataFrame:
    return e.select(
        F.when(F.col("event_id") % 5 == 0, F.trunc(_months_back("1 + event_id % 17"), "month"))
         .otherwise(F.to_date("ts")).alias("day"),
        F.concat(F.lit("term "), _txt(F.col("user_id") * 4 + F.col("event_id") % 4)).alias("query"),
        F.concat(F.lit("/p/"), _txt(F.expr("user_id div 2"))).alias("page"),
        F.lit("BRA").alias("country"),
        F.when(F.col("user_id") % 3 == 0, F.lit("DESKTOP"))
         .when(F.col("user_id") % 3 == 1, F.lit("MOBILE"))
         .otherwise(F.lit("TABLET")).alias("device"),
        "event_id", "event_type")


def _position(event_ids: Column) -> Column:
    return ((F.lit(100) + F.sum(event_ids) % 5000) * F.lit(Decimal("0.01"))).cast("decimal(6,2)")


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _search_keys(read_base(spark, sf_dir, "events"))
    return e.groupBy("day", "query", "page", "country", "device").agg(
        F.count_if(F.col("event_type") == "click").cast("int").alias("clicks"),
        F.when(F.max("event_id") % 7 == 0, F.lit(0))
         .otherwise(F.count(F.lit(1)) * 10).cast("int").alias("impressions"),
        _position(F.col("event_id")).alias("position"),
    )


def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _search_keys(read_base(spark, sf_dir, "events"))
    return e.groupBy("day", "page").agg(
        F.count_if(F.col("event_type") == "click").cast("int").alias("clicks"),
        (F.count(F.lit(1)) * 12).cast("int").alias("impressions"),
        _position(F.col("event_id")).alias("position"),
    )


VIEWS = {
    "sales": sales, "sale_items": sale_items, "products": products,
    "customers": customers, "payables": payables,
    "subscription_sales": subscription_sales, "subscriptions": subscriptions,
    "shipments": shipments, "search_queries": search_queries,
    "search_pages": search_pages,
}
