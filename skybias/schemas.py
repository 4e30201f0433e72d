"""Fixed schemas, field lists and labels of the domain tables."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------------------------
POLLUTANTS = ["pm25", "no2", "o3", "so2", "pm10"]
RAW_FIELDS = ["blh", "d2m", "dsrp", "go3", "msl", "no2", "pm10", "pm2p5",
              "so2", "t2m", "tcc", "tp", "u10", "uvb", "v10", "z"]
FIELD_RENAMES = {"pm2p5": "pm25", "go3": "o3"}
ACCUMULATED = ["dsrp", "tp", "uvb"]
LEADS = [0, 3, 6, 9, 12, 15, 18, 21]
UNIT_NAMES = {"µg/m³": "microgram / m^3", "ppm": "ppm"}
LONG_NAMES = {"no2": "Nitrogen dioxide", "o3": "Ozone", "pm25": "Particulate matter (PM2.5)"}
REFERENCE_GRADE = "reference grade"
SERIES_LABELS = {"cams": "CAMS", "observations": "Observations",
                 "corrected": "Corrected CAMS", "persistence": "Persistence"}
RESAMPLINGS = ["H", "3H", "6H", "12H", "D", "3D", "7D", "15D", "MS", "QS", "No Resampling"]
# ----------------------------------------------------------------------------------------------

FIELDS = [FIELD_RENAMES.get(f, f) for f in RAW_FIELDS]
FORECAST_TYPES = ["cams", "corrected", "persistence"]
SERIES = ["location_id", "variable"]
METRICS = ["nmae", "bias", "rmse", "debiased_nmae", "pearson"]


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


_s, _d, _l, _i, _t, _b = (T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(),
                          T.TimestampType(), T.BooleanType())

LOCATIONS_CSV = T.StructType([
    T.StructField("row", _l), T.StructField("id", _s), T.StructField("city", _s),
    T.StructField("country", _s), T.StructField("latitude", _d), T.StructField("longitude", _d),
    T.StructField("timezone", _s), T.StructField("elevation", _d)])

CATALOGUE = T.StructType([
    T.StructField("id", _l), T.StructField("city", _s), T.StructField("name", _s),
    T.StructField("entity", _s), T.StructField("country", _s),
    T.StructField("sources", T.ArrayType(_struct(id=_s, url=_s, name=_s))),
    T.StructField("isMobile", _b), T.StructField("isAnalysis", _b),
    T.StructField("parameters", T.ArrayType(_struct(
        id=_l, unit=_s, count=_l, average=_d, lastValue=_d, parameter=_s, displayName=_s,
        lastUpdated=_t, parameterId=_i, firstUpdated=_t))),
    T.StructField("sensorType", _s), T.StructField("lastUpdated", _t),
    T.StructField("firstUpdated", _t), T.StructField("measurements", _l),
    T.StructField("coordinates", _struct(latitude=_d, longitude=_d))])
