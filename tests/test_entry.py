from __future__ import annotations

import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_can_be_listed_without_a_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    queries, oracles = map(int, out.stdout.split())
    assert queries >= oracles >= 90


def test_every_oracle_has_a_query():
    assert not set(entry.oracle_sql()) - set(entry.queries())


def test_flagship(spark):
    found = entry.entry(spark)
    assert found.columns == ["tool", "mean_rank", "case_mean_rank", "cells", "cases"] and found.count() > 0
