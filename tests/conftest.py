from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tallywind import JobConfig, build_session

    extra = {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    session = build_session(JobConfig(master="local[8]", shuffle_partitions=4), extra)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def txn(spark, sf_dir):
    from tallywind.sources.fixtures import transactions

    return transactions(spark, sf_dir)
