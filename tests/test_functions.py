"""Column functions on hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from skybias.functions import physics
from skybias.functions.geo import grid_longitude, haversine_km
from skybias.functions.stats import nan_to_null, pearson
from skybias.functions.timeparts import lag_label, lead_label, local_hour, slug, time_features, time_part
from skybias.operators.sensors import unit_label, valid_variable


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_haversine_one_degree(spark):
    d = one(spark, haversine_km(F.lit(10.0), F.lit(10.0), F.lit(11.0), F.lit(11.0)))[0]
    assert round(d) == 156


def test_haversine_antipodes_and_same_point(spark):
    row = one(spark, haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)),
              haversine_km(F.lit(45.0), F.lit(7.0), F.lit(45.0), F.lit(7.0)))
    assert row[0] == pytest.approx(math.pi * 6373.0) and row[1] == 0


def test_grid_longitude(spark):
    assert list(one(spark, grid_longitude(F.lit(-3.7)), grid_longitude(F.lit(31.2)))) == pytest.approx([356.3, 31.2])


def test_ppm_conversion_and_pm25_error(spark):
    row = one(spark, physics.ppm_to_ugm3(F.lit(0.02), F.lit("ppm"), F.lit("o3")),
              physics.ppm_to_ugm3(F.lit(0.02), F.lit("ppm"), F.lit("no2")),
              physics.ppm_to_ugm3(F.lit(20.0), F.lit("µg/m³"), F.lit("o3")))
    assert list(row) == pytest.approx([0.02 * 0.0409 * 48 * 1e3, 0.02 * 0.0409 * 46.01 * 1e3, 20.0])
    with pytest.raises(Exception, match="pm25 readings are in ppm"):
        one(spark, physics.ppm_to_ugm3(F.lit(1.0), F.lit("ppm"), F.lit("pm25")))


def test_pressure_and_density(spark):
    p, rho = one(spark, physics.surface_pressure(F.lit(101325.0), F.lit(288.15), F.lit(668.0)),
                 physics.air_density(F.lit(101325.0), F.lit(288.15)))
    assert p == pytest.approx(101325 * (1 - 0.0065 / 288.15 * 668) ** 5.255786, rel=1e-4)
    assert rho == pytest.approx(1.22498, rel=1e-4)


def test_local_hour_follows_daylight_saving(spark):
    t = F.lit("2024-07-01 12:00:00").cast("timestamp")
    w = F.lit("2024-01-01 12:00:00").cast("timestamp")
    row = one(spark, local_hour(t, F.lit("Europe/Madrid")), local_hour(w, F.lit("Europe/Madrid")),
              local_hour(w, F.lit("America/Guayaquil")))
    assert list(row) == [14, 13, 7]


def test_time_features(spark):
    t = F.lit("2024-03-01 06:00:00").cast("timestamp")
    assert list(one(spark, *time_features(F.lit(6), t))) == pytest.approx([0, 1, 0, 1], abs=1e-12)
    assert list(one(spark, *time_features(F.lit(6), t, numeric=False))) == [6, 3]
    with pytest.raises(NotImplementedError):
        time_part(t, "week")


def test_labels(spark):
    assert [lag_label(i, 24) for i in (0, 23, 24, 47)] == ["-24", "-01", "00", "23"]
    row = one(spark, lead_label(F.lit(3)), slug(F.lit("United Kingdom")), slug(F.lit("Addis Abeba"), ""),
              unit_label(F.lit("µg/m³")))
    assert list(row) == ["003", "united-kingdom", "addisabeba", "microgram / m^3"]


def test_unknown_variable():
    assert valid_variable("o3") == "o3"
    with pytest.raises(NotImplementedError):
        valid_variable("co")


def test_nan_becomes_null_and_constant_side_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (None, 3.0)], "x DOUBLE, y DOUBLE")
    assert df.agg(pearson(F.col("x"), F.col("y"))).first()[0] is None
    assert one(spark, nan_to_null(F.lit(float("nan"))))[0] is None


def test_p_values_of_very_long_series():
    """At n = 1e10 the t distribution is normal: p = erfc(|t| / sqrt 2)."""
    import math

    import numpy as np
    import pandas as pd

    from skybias.operators.weighted import _p_values

    n, z = 1e10, np.array([0.1, 1.0, 1.96, 3.0])
    got = _p_values(pd.Series(z / math.sqrt(n)), pd.Series([n] * 4))
    assert got.tolist() == pytest.approx([math.erfc(x / math.sqrt(2)) for x in z], abs=1e-7)
