"""Every registered query of the library against its SQL, on the smallest tables."""

import harness
import pytest

from pedolake.plans import registry

ORACLES = registry.oracle_sql()
#: Need whole 3 x 3 windows or a wide grid, which the smallest tables do not fill.
WIDE = {"crop_mask", "dah", "hillshade", "slope_aspect", "surface_area", "tri", "convergence", "curvatures", "tpi_landforms", "vrm"}
LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, duck, name):
    at, con = (LARGER, harness.connect(LARGER)) if name in WIDE else (sf, duck)
    said = harness.compare(registry.queries()[name](spark, at), con, ORACLES[name])
    assert not said, said


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, LARGER if name in WIDE else sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
