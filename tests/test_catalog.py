"""Queries of the catalog run over all rows of their tables."""

from __future__ import annotations

import os

import pytest

from cartolina.plans import catalog

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_every_event_reaches_its_gate(spark):
    told = catalog.admissions(spark, SF)
    assert told.count() == catalog._table(spark, SF, "events").count() and told.select("gate").distinct().count() == 40


def test_layout_places_every_nation(spark):
    nodes = catalog._nation(spark, SF)[0]
    placed = catalog.community_layout(spark, SF).select("repo", "id")
    assert placed.count() == nodes.count() and not nodes.exceptAll(placed).count()


def test_every_part_is_a_symbol_and_a_file(spark):
    parts = catalog._table(spark, SF, "part").count()
    assert catalog._symbols(spark, SF).count() == catalog._imports(spark, SF)[2].count() == parts


@pytest.mark.parametrize("name", ["ref_counts", "resolved_calls", "import_edges", "dangling_imports"])
def test_names_resolve_as_in_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    held = duckdb.connect()
    for table in ("part", "lineitem"):
        held.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = held.execute(catalog.ORACLE_SQL[name]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect())) == sorted(want)
