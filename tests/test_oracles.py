"""Every registered query against its SQL, plus the driver's entry points."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry_points
from compare import compare, connect
from gradus import checks

QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [name for name in QUERIES if name in ORACLES])
def test_matches_sql(spark, con, sf, name):
    problem, *_ = compare(spark, con, name, QUERIES[name], ORACLES[name], sf)
    assert problem is None, problem


def test_entry(spark):
    assert {r["label"]: r["n"] for r in entry_points.entry(spark).collect()} == {"Late": 187, "On time": 73}


def test_every_core_query_has_sql():
    assert set(checks.queries) == set(checks.oracles)


def test_entry_without_the_training_text_package(tmp_path):
    """What stays after the optional package, its pipeline and its tests are deleted still imports and collects."""
    root = os.path.dirname(os.path.abspath(entry_points.__file__))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache"))
    listed = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"],
        cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert listed.stdout.split() == [str(len(checks.queries)), str(len(checks.oracles))], listed.stderr
    collected = subprocess.run(
        [sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"],
        cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert collected.returncode == 0, collected.stdout[-2000:]
