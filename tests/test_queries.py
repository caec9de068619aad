"""Every registered query against its DuckDB oracle (the driver's correctness gate), plus the smoke entry."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_CHECK, SF_SMALL
from tests.oracle_check import compare

SLOW = {"stream_requests", "stream_file_changes"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "symbol" in df.columns


@pytest.mark.parametrize("key", sorted(k for k in E.queries() if k not in SLOW))
def test_query_matches_oracle(spark, key):
    res = compare(spark, SF_CHECK, [key], verbose=False)[key]
    assert res[0] in ("OK", "rows-only"), res


@pytest.mark.parametrize("key", sorted(SLOW))
def test_stream_matches_oracle_small(spark, key):
    res = compare(spark, SF_SMALL, [key], verbose=False)[key]
    assert res[0] == "OK", res
