from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from viewlog.session import local_session  # noqa: E402

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("shared")
    session = local_session(
        8,
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": str(base),
            "spark.sql.warehouse.dir": str(base / "warehouse"),
            "spark.driver.memory": "8g",
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not DATA.exists():
        pytest.skip(f"no tables at {DATA}")
    return str(DATA)


@pytest.fixture
def plan():
    """The physical plan of a DataFrame before it runs, as text."""

    def text(df) -> str:
        return df._jdf.queryExecution().executedPlan().toString()

    return text
