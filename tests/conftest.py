from __future__ import annotations

import os

import pytest

# small matrix products are slower on many threads; this has to come before numpy
os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

from cadenza.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    s = session(
        "tests", 4, 4,
        **{"spark.checkpoint.dir": f"file://{root}/shared", "spark.local.dir": str(root / "local"), "spark.sql.warehouse.dir": str(root / "warehouse")},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
