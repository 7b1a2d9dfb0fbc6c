"""The entry points without the subpackage's libraries."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("library", ["ahocorasick", "zstandard", "duckdb", "clientela.llm", "corpus_pipeline"])
def test_products_need_no_library_of_the_subpackage(library):
    code = (
        f"import sys; sys.modules[{library!r}] = None\n"
        "import __spark_entry__ as entry\n"
        "from checks.queries import QUERIES\n"
        "assert entry.queries() == QUERIES and set(entry.oracle_sql()) == set(QUERIES)\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
