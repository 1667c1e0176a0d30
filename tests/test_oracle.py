"""Every registered query against its SQL, or at least run, on the smallest data."""

import os

import oracle
import pytest

import __spark_entry__ as entry
from tarnlight.plans import registry

FOLDER = "/root/testdata/sf0.001"
#: Queries whose rows exist only in larger data, which they are tested on.
LARGER, RARE = "/root/testdata/sf0.01", set("W8 R4 A8 V17 V21 F4 C25 M15 V26 V16 W7 V25 T9 V11 F11 F6 J2 T1 V4".split())

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def views():
    return {folder: oracle.connect(folder) for folder in (FOLDER, LARGER)}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, views, name):
    folder = LARGER if name in RARE else FOLDER
    frame = registry.QUERIES[name](spark, folder)
    if name in registry.SQL:
        assert oracle.compare(frame, views[folder], registry.SQL[name]) == ""
    else:
        assert frame.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
