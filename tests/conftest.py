import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lexigrove.session import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})


@pytest.fixture(scope="session")
def work(spark):
    from lexigrove.plans.workspace import workspace

    return workspace(spark, SMALL)


RECORDS = (
    "record_no bigint, id string, source string, domain string, token_count bigint, source_row bigint, "
    "content_quality string, pii_presence string, content_type array<string>, educational_value string")


@pytest.fixture(scope="session")
def four(spark):
    """Four records: all labels missing in one, a repeated label in another."""
    return spark.createDataFrame([
        (0, "a", "s1", "Books", 10, 0, "good", "no_pii", ["news_report", "news_report"], "high"),
        (1, "b", "s1", "Books", 50, 1, "poor", "contains_pii", ["opinion", "creative"], "none"),
        (2, "c", "s2", "News", 1000, 0, None, None, None, None),
        (3, "d", "s2", "News", 100, 1, "good", "no_pii", [], "none"),
    ], RECORDS)
