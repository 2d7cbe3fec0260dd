"""Every registered query with an oracle equals it on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from millrace.plans import code, commits, credit, instances, registry, reports, scores, texts  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v):.5g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_oracle(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    have = sorted(tuple(cell(r[c]) for c in columns) for r in got.collect())
    result = duck.execute(registry.oracles()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(cell(r[i]) for i in at) for r in result.fetchall())
    assert len(have) == len(want)
    close = lambda a, b: a == b or (a and b and a[-1].isdigit() and b[-1].isdigit() and abs(float(a) - float(b)) <= 1e-3 * max(1, abs(float(a))))
    assert all(all(close(x, y) for x, y in zip(h, w)) for h, w in zip(have, want))
