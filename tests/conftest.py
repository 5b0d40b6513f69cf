import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusloom.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Lower the limits, so that small tables take the paths meant for hot groups."""
    spark.conf.set("corpusloom.hotRows", "40")
    spark.conf.set("corpusloom.smallSideRows", "25")
    yield
    spark.conf.unset("corpusloom.hotRows")
    spark.conf.unset("corpusloom.smallSideRows")


@pytest.fixture(scope="session")
def skewed(spark):
    """600 rows; group 'a' holds more than a third, many values are equal."""
    rows = []
    for i in range(600):
        group = "a" if i % 5 < 2 else f"g{i % 13}"
        rows.append((i, group, (i * 37) % 101, float((i * i) % 23) if i % 11 else None))
    return spark.createDataFrame(rows, "id bigint, grp string, t bigint, x double")
