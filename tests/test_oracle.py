"""Every registered query against DuckDB.

On the driver's tables as they would run there, and on a star full of hot keys with everything
that depends on size forced onto the way taken at scale.
"""

import pytest

import __spark_entry__ as entry
from checks import queries
from checks.compare import difference, duckdb_views
from checks.oracle import ORACLE
from checks.queries import QUERIES
from clientela.sources.star import star_ledger
from tests.star import write_hot_star

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small():
    return duckdb_views(SMALL)


@pytest.fixture(scope="module")
def hot(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hot"))
    write_hot_star(folder)
    return folder, duckdb_views(folder)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_types(spark, small, name):
    """Plain types only, the same on both sides."""
    ours = dict(QUERIES[name](spark, SMALL).dtypes)
    alike = {"VARCHAR": "string", "DOUBLE": "double", "BIGINT": "bigint"}
    columns = small.execute(f"DESCRIBE {ORACLE[name]}").fetchall()
    assert ours == {column[0]: alike[column[1]] for column in columns}


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 9
    assert sum(row["customers"] for row in rows) == 143


@pytest.mark.parametrize("name", list(QUERIES))
def test_small(spark, small, name):
    assert difference(spark, small, SMALL, name, QUERIES[name], ORACLE[name]) is None


@pytest.fixture
def at_scale(monkeypatch, conf):
    """No list is small enough to broadcast, every skew is worth splitting."""
    monkeypatch.setattr(
        queries, "ledger", lambda *args: star_ledger(*args, broadcast_rows=0)
    )
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__files__maxPartitionBytes="100KB",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="8KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="2KB",
    )


@pytest.mark.parametrize("name", list(QUERIES))
def test_hot_keys(spark, hot, at_scale, name):
    folder, connection = hot
    assert difference(spark, connection, folder, name, QUERIES[name], ORACLE[name]) is None
