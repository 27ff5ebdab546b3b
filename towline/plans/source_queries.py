"""Queries that write a table and read it back through the sources."""

from __future__ import annotations

import uuid

from ..session import checkpoint_folder
from ..sources import load_table, read_table, save_table, write_csv
from . import testviews as tv
from .registry import query


def _folder(spark) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/towline-scan-{uuid.uuid4().hex}"


_SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


@query("typed_csv_scan", _SUPPLIER)
def typed_csv_scan(spark, sf):
    path = _folder(spark)
    write_csv(tv.table(spark, sf, "supplier"), path)
    return read_table(spark, path, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", format="csv")


@query("inferred_csv_scan", "SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def inferred_csv_scan(spark, sf):
    path = _folder(spark)
    write_csv(tv.table(spark, sf, "supplier"), path)
    return read_table(spark, path, format="csv")


@query("sheet_scan", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def sheet_scan(spark, sf):
    # A sheet lands as Parquet; the scan casts it to the declared types.
    path = _folder(spark)
    save_table(tv.table(spark, sf, "part"), path)
    return read_table(spark, path, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", format="parquet")


@query("saved_by_year", "SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def saved_by_year(spark, sf):
    path = _folder(spark)
    orders = tv.table(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice", "year(o_orderdate) AS year")
    save_table(orders, path, partition_by=["year"])
    return load_table(spark, path)
