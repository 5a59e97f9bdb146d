"""The registered sandbox query loads every rendered table."""

import os

import pytest

from gridloom import queries
from gridloom.plans import sandbox

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_all_rendered_tables_are_loaded(spark, monkeypatch):
    loaded, load = [], sandbox.TableSandbox.load_tables

    def spy(self, blocks):
        names = list(load(self, blocks))
        loaded.extend(names)
        return names

    monkeypatch.setattr(sandbox.TableSandbox, "load_tables", spy)
    assert queries.sandbox_sql(spark, SMALL).count() == 1
    assert len(loaded) == len(set(loaded)) == 5
