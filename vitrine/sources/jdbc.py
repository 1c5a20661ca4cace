"""Reading the shop tables straight from the operational database (JDBC).

No table is pulled over one connection. With ``bounds`` (low, high of the
table's split column, a numeric or date column, best an indexed one) the read
is split into ``num_partitions`` range queries. Without them a table with a key
is split by a hash of the key: a row that is updated during the load stays in its
part, and a hot value other than the key does no harm. A table without a known
key is split by ranges of its pages (``pages``: its size in pages, as the
database's catalog tells), which also spares each query the scan of the whole
table, else by a hash of the row.

The parts are separate queries, so on a live table they must see one snapshot:
with ``snapshot`` (the id that ``pg_export_snapshot()`` returned in a transaction
the caller keeps open) every connection joins it before it reads. Without it,
rows written during the load may be missed or read in two versions.

``JdbcChanges`` serves the incremental pull (``pull.py``): the stamp and the join of
lines to their changed sales are part of the SQL sent, so only changed rows
leave the database, and of the others only the keys.

Column pruning and simple filters are pushed into the SQL Spark sends.
``to_engine_columns`` gives the rows the engine's names and types, so the
load step and every query take them as they are. The reader needs the
database's JDBC driver jar on the classpath (not shipped here, so only its
options, its SQL and the mapping are tested).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES
from .tables import Tables

# Table and column names of the source database, which the
# engine must read as they are.
# our table -> (source table, split column of a read with bounds)
DEFAULT_SOURCES = {
    "sales": ("tiny_vendas", "id_tiny"),
    "sale_items": ("tiny_vendas_itens", "id_pedido"),
    "products": ("tiny_produtos", None),
    "customers": ("tiny_clientes", None),
    "payables": ("tiny_contas_pagar_pu", None),
    "subscription_sales": ("guru_vendas", None),
    "subscriptions": ("guru_assinaturas", None),
    "shipments": ("rastreio_pedidos", "id_venda_tiny"),
    "search_queries": ("gsc_queries", "data"),
    "search_pages": ("gsc_pages", "data"),
}

# Source column -> our column, per table (the source schema is Portuguese).
RENAMES = {
    "sales": {"id_tiny": "sale_id", "numero": "sale_number", "numero_ecommerce": "marketplace_number",
              "id_contato": "customer_id", "nome_cliente": "customer_name",
              "data_pedido": "sale_date_text", "situacao": "status", "total_pedido": "total",
              "total_produtos": "products_total", "valor_frete": "freight",
              "valor_desconto": "discount", "canal_venda": "channel", "ecommerce": "marketplace",
              "meio_pagamento": "payment_method", "forma_pagamento": "payment_form",
              "forma_envio": "ship_method", "uf_cliente": "state", "synced_at": "synced_at_text"},
    "sale_items": {"id_pedido": "sale_id", "descricao": "description", "codigo_produto": "sku",
                   "quantidade": "quantity", "valor_total": "line_total",
                   "valor_unitario": "unit_price"},
    "products": {"nome": "name", "codigo": "sku", "estoque_atual": "stock", "preco": "price",
                 "preco_custo": "cost", "situacao": "status"},
    "customers": {"data_criacao": "created_text"},
    "payables": {"valor": "amount", "saldo": "balance", "data_vencimento": "due_date_text",
                 "competencia": "period_label"},
    "subscription_sales": {"confirmed_at": "confirmed_at_text", "valor_liquido": "net_amount"},
    "subscriptions": {"started_at": "started_at_text"},
    "shipments": {"codigo_rastreio": "tracking_code", "status_atual": "status_text",
                  "ultima_verificacao": "last_checked", "dt_prevista": "due_date",
                  "forma_frete": "ship_form", "id_venda_tiny": "sale_id", "entregue": "delivered"},
    "search_queries": {"data": "day"},
    "search_pages": {"data": "day"},
}

# Source key columns, and the column that stamps a sale's last write.
KEYS = {"sales": "id_tiny", "sale_items": "id_pedido", "products": "codigo", "shipments": "codigo_rastreio"}
STAMP = "synced_at"

# Row ids the source tables do not provide under a known name. They only break
# ties in the load step's clustering, so a digest of the row serves.
ROW_IDS = {"customers": "customer_id", "subscription_sales": "event_id", "subscriptions": "event_id"}


def jdbc_options(url: str, table: str, properties: Mapping[str, str],
                 partition_column: str | None = None, bounds: tuple | None = None,
                 num_partitions: int = 64, fetch_size: int = 10_000) -> dict[str, str]:
    opts = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **properties}
    if partition_column and bounds:
        opts.update(partitionColumn=partition_column, lowerBound=str(bounds[0]),
                    upperBound=str(bounds[1]), numPartitions=str(num_partitions))
    return opts


def row_hash_predicates(source: str, parts: int) -> list[str]:
    """Conditions that deal the rows of a PostgreSQL table into ``parts``
    disjoint, complete and even parts (a table name stands for its row)."""
    return [f"abs(hashtext({source}::text)::bigint) % {parts} = {k}" for k in range(parts)]


def key_hash_predicates(key: str, parts: int) -> list[str]:
    """The same by the key alone; rows without a key are in the first part."""
    return [f"abs(hashtext({key}::text)::bigint) % {parts} = {k}" + (f" OR {key} IS NULL" if k == 0 else "") for k in range(parts)]


def page_predicates(pages: int, parts: int) -> list[str]:
    """The same by ranges of physical pages; the last part is open, as the
    table may have grown."""
    cuts = sorted({pages * k // parts for k in range(1, parts)} - {0})
    lows, highs = [None, *cuts], [*cuts, None]
    return [" AND ".join(x for x in (low is not None and f"ctid >= '({low},0)'::tid", high is not None and f"ctid < '({high},0)'::tid") if x)
            or "true" for low, high in zip(lows, highs)]


def snapshot_options(snapshot: str | None) -> dict[str, str]:
    """Options that make each connection read the exported snapshot."""
    if snapshot is None:
        return {}
    if not set(snapshot) <= set("0123456789ABCDEFabcdef-"):
        raise ValueError(f"not a snapshot id: {snapshot!r}")
    return {"sessionInitStatement": f"SET TRANSACTION ISOLATION LEVEL REPEATABLE READ; SET TRANSACTION SNAPSHOT '{snapshot}'"}


def _read_parts(spark: SparkSession, url: str, dbtable: str, predicates: list[str], properties: Mapping[str, str],
                snapshot: str | None) -> DataFrame:
    opts = jdbc_options(url, dbtable, {**properties, **snapshot_options(snapshot)})
    return spark.read.jdbc(url, dbtable, predicates=predicates,
                           properties={k: v for k, v in opts.items() if k not in ("url", "dbtable")})


def to_engine_columns(df: DataFrame, table: str) -> DataFrame:
    """A source table with the engine's names and types: known columns are
    renamed and cast to ``schemas.py`` (an unbounded NUMERIC arrives as
    decimal(38,18), a timestamp where the engine reads text), other columns go,
    and a missing row id is a digest of the source row."""
    row_id = ROW_IDS.get(table)
    names = RENAMES.get(table, {})
    digest = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    df = df.withColumn("_row_digest", digest).withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})
    out = []
    for field in TABLES[table].fields:
        if field.name in df.columns:
            out.append(F.col(field.name).cast(field.dataType).alias(field.name))
        elif field.name == row_id:
            out.append(F.col("_row_digest").alias(row_id))
    return df.select(*out)


def from_jdbc(spark: SparkSession, url: str, properties: Mapping[str, str],
              bounds: Mapping[str, tuple] | None = None, num_partitions: int = 64,
              sources: Mapping[str, tuple] = DEFAULT_SOURCES, snapshot: str | None = None,
              pages: Mapping[str, int] | None = None) -> Tables:
    """Tables read over JDBC with the engine's columns.

    ``bounds`` maps our table name to (low, high) of its split column, ``pages``
    to its size in pages; a table in neither is split by the hash of its key, or of
    its rows. ``snapshot``: the exported snapshot that all reads share."""
    bounds, pages = bounds or {}, pages or {}

    def reader(name: str):
        source, part = sources[name]
        if part and name in bounds:
            opts = jdbc_options(url, source, {**properties, **snapshot_options(snapshot)}, part, bounds[name], num_partitions)
            df = spark.read.format("jdbc").options(**opts).load()
        else:
            split = page_predicates(pages[name], num_partitions) if name in pages \
                else key_hash_predicates(KEYS[name], num_partitions) if name in KEYS else row_hash_predicates(source, num_partitions)
            df = _read_parts(spark, url, source, split, properties, snapshot)
        return to_engine_columns(df, name)

    return Tables({name: (lambda n=name: reader(n)) for name in sources})


class JdbcChanges:
    """Changes of the operational database for ``pull.pull_sales``; the SQL
    selects them, split by the hash of the sale's key, in one snapshot."""

    def __init__(self, spark: SparkSession, url: str, properties: Mapping[str, str], num_partitions: int = 64,
                 snapshot: str | None = None, sources: Mapping[str, tuple] = DEFAULT_SOURCES):
        self.spark, self.url, self.properties = spark, url, properties
        self.parts, self.snapshot, self.sources = num_partitions, snapshot, sources

    def query(self, what: str, since=None) -> str:
        """SQL of the ``sales``, ``sale_items`` or ``keys`` of a pull."""
        sales, key = self.sources["sales"][0], KEYS["sales"]
        if what == "keys":
            return f"(SELECT {key} FROM {sales}) AS changes"
        changed = "" if since is None else f" WHERE v.{STAMP} IS NULL OR v.{STAMP}::timestamp >= TIMESTAMP '{since.isoformat(sep=' ')}'"
        if what == "sales":
            return f"(SELECT v.* FROM {sales} v{changed}) AS changes"
        return f"(SELECT i.* FROM {self.sources['sale_items'][0]} i JOIN {sales} v ON v.{key} = i.{KEYS['sale_items']}{changed}) AS changes"

    def _read(self, what: str, key: str, since=None) -> DataFrame:
        return _read_parts(self.spark, self.url, self.query(what, since), key_hash_predicates(key, self.parts), self.properties, self.snapshot)

    def sales(self, since) -> DataFrame:
        return to_engine_columns(self._read("sales", KEYS["sales"], since), "sales")

    def lines(self, since) -> DataFrame:
        return to_engine_columns(self._read("sale_items", KEYS["sale_items"], since), "sale_items")

    def keys(self) -> DataFrame:
        return self._read("keys", KEYS["sales"]).select(F.col(KEYS["sales"]).cast("long").alias("sale_id"))
