import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from bench import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session(8)
    yield spark
    spark.stop()


@pytest.fixture
def conf(spark):
    """Set configuration for one test."""
    before = {}

    def set_conf(**values):
        for key, value in values.items():
            key = key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield set_conf
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
