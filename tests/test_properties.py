"""Audits against a brute-force Python check on random small frames (NULLs and repeats included)."""

from __future__ import annotations

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stockroom.operators import quality

keys = st.lists(st.one_of(st.none(), st.integers(0, 6)), min_size=0, max_size=25)
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(values=keys)
def test_primary_and_unique_keys(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "k int")
    counts = Counter(values)
    want_pk = {k: n for k, n in counts.items() if n > 1 or k is None}
    want_uq = {k: n for k, n in counts.items() if n > 1 and k is not None}
    assert {r.k: r.n for r in quality.audit_primary_key(df, "k").collect()} == want_pk
    assert {r.k: r.n for r in quality.audit_unique(df, "k").collect()} == want_uq


@SETTINGS
@given(child=keys, parent=st.lists(st.one_of(st.none(), st.integers(0, 6)), max_size=8))
def test_foreign_key(spark, child, parent):
    c = spark.createDataFrame([(i, v) for i, v in enumerate(child)], "id int, fk int")
    p = spark.createDataFrame([(v,) for v in parent], "pk int")
    present = {v for v in parent if v is not None}
    want = sorted(i for i, v in enumerate(child) if v is not None and v not in present)
    got = sorted(r.id for r in quality.audit_foreign_key(c, p, "fk", "pk").collect())
    assert got == want


@SETTINGS
@given(values=st.lists(st.one_of(st.none(), st.integers(-3, 3)), max_size=20))
def test_check_constraint(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, quantity int")
    want = sorted(i for i, v in enumerate(values) if v is not None and not v >= 0)
    assert sorted(r.id for r in quality.audit_check(df, "quantity >= 0").collect()) == want
