"""Shared session and a small catalog."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from shortlist.schemas import CATALOG  # noqa: E402
from shortlist.session import local_session  # noqa: E402

ITEMS = [
    # id, name, url, types, description, duration, levels, remote, adaptive, vector
    (1, "Core Java", "u/1", ["K"], "java coding test for developers", "30 minutes", ["Manager"], True, True, [1.0, 0.0, 0.0]),
    (2, "Java Advanced", "u/2", ["K", "S"], "advanced java simulation", "45 minutes", ["Director"], False, True, [0.8, 0.6, 0.0]),
    (3, "Sales Drive", "u/3", ["P"], "personality of sales people", "", None, True, False, [0.0, 1.0, 0.0]),
    (4, "Verbal 50% Plus", "u/4", [], "verbal ability", "Variable", ["Manager", "Executive"], False, False, None),
    (5, "Numerical", "u/5", None, None, None, [], True, True, [0.0, 0.0, 0.0]),
    (6, "core java", "u/6", ["A", "K"], "duplicate name java", "30-45 minutes", ["Graduate"], True, False, [-1.0, 0.0, 0.0]),
]


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def catalog(spark):
    return spark.createDataFrame(ITEMS, CATALOG)


@pytest.fixture(scope="session")
def index(catalog):
    from shortlist.operators.index import build_index

    return build_index(catalog)
