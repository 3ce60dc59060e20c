"""Registered queries over whole tables against SQL in DuckDB."""

from __future__ import annotations

import pytest

import check_oracle
from panelytics.llm import queries


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_equals_sql(spark, sf_dir, name):
    assert check_oracle.compare(spark, check_oracle.duck(sf_dir), name, sf_dir) is None
