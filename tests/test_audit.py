"""The audit's health against the mails of its period, counted in Python."""

import datetime as dt
import os

import pytest

from claimflow.plans import records
from claimflow.sources.adapters import domain

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/orders.parquet"), reason="no test tables")


def test_audit_summary_counts_the_mails_of_its_period(spark):
    times = [r["received_at"] for r in domain(spark, SF, "emails").select("received_at").collect()]
    n = sum(records.NOW - dt.timedelta(days=400) <= t <= records.NOW for t in times)
    issues = records.x4_audit(spark, SF).count()
    assert 0 < issues < n != 5000
    got = records.x5_audit_summary(spark, SF).first()
    assert got["health"] == pytest.approx((n - issues) / n, abs=1e-6)
