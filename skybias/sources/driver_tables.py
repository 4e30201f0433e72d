"""Domain tables derived from the driver's ``events`` table, so that work grows with it.

Thirty users make one location; every user is a sensor, every event a reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skybias.operators.chunks import with_rank
from skybias.schemas import RAW_FIELDS, REFERENCE_GRADE, SERIES
from skybias.functions.timeparts import shift_hours

# --- fixed values: five stations that the locations are modelled on -----------------------------
STATIONS = {
    "location_id": ["ES001", "EC001", "FR001", "GB002", "EG001"],
    "city": ["Madrid", "Quito", "Paris", "Glasgow", "Cairo"],
    "country": ["Spain", "Ecuador", "France", "United Kingdom", "Egypt"],
    "latitude": [40.4165, -0.22985, 48.85341, 55.86515, 30.06263],
    "longitude": [-3.70256, -78.52495, 2.3488, -4.25763, 31.24967],
    "timezone": ["Europe/Madrid", "America/Guayaquil", "Europe/Paris", "Europe/London", "Africa/Cairo"],
    "elevation": [668.0, 2849.0, 38.0, 38.0, 28.0],
}
EVENT_VARIABLES = {"click": "pm25", "view": "no2", "purchase": "o3", "signup": "so2", "error": "pm10"}
USERS_PER_LOCATION = 30
PERIOD = ("2024-01-01", "2024-01-31")
# ------------------------------------------------------------------------------------------------


def _station(name: str, k: Column) -> Column:
    values = ", ".join(f"{v}D" if isinstance(v, float) else f"'{v}'" for v in STATIONS[name])
    return F.get(F.expr(f"array({values})"), F.pmod(k, F.lit(5)).cast("int"))


def _home(k: Column) -> tuple[Column, Column]:
    """Latitude and longitude of location k; every fifth location moves 2 degrees north or 3 east."""
    lap = F.floor(k / 5)
    latitude = _station("latitude", k) + F.pmod(lap, F.lit(9)) * 2.0
    longitude = _station("longitude", k) + F.pmod(lap, F.lit(120)) * 3.0
    return latitude, F.when(longitude >= 180, longitude - 360).otherwise(longitude)


def _location_id(k: Column) -> Column:
    lap = F.floor(k / 5)
    suffix = F.when(lap > 0, F.concat(F.lit("-"), lap.cast("string"))).otherwise("")
    return F.concat(_station("location_id", k), suffix)


def location_number(user_id: Column) -> Column:
    return F.floor(user_id / USERS_PER_LOCATION)


def home_location_id(user_id: Column) -> Column:
    return _location_id(location_number(user_id))


def member_biases(hours: DataFrame, members: int = 5) -> DataFrame:
    """Add ``member`` and its ``bias_hat`` to the hours of runs."""
    return (hours.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
            .withColumn("bias_hat", F.col("bias") * (0.8 + F.col("member") * 0.1)))


class DriverTables:
    """The domain tables of one scale factor, each a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def events(self) -> DataFrame:
        return (self.spark.read.parquet(f"{self.sf_dir}/events.parquet")
                .withColumn("ts", F.col("ts").cast("timestamp")))

    def locations(self) -> DataFrame:
        k = F.col("k")
        latitude, longitude = _home(k)
        suffix = F.when(k >= 5, F.concat(F.lit(" "), F.floor(k / 5).cast("string"))).otherwise("")
        return (self.events().select(location_number(F.col("user_id")).alias("k")).distinct()
                .select(_location_id(k).alias("location_id"), F.concat(_station("city", k), suffix).alias("city"),
                        _station("country", k).alias("country"), latitude.alias("latitude"),
                        longitude.alias("longitude"), _station("timezone", k).alias("timezone"),
                        _station("elevation", k).alias("elevation")))

    def measurements(self) -> DataFrame:
        user, kind = F.col("user_id"), F.col("event_type")
        gas = kind.isin("view", "purchase")
        in_ppm = gas & ((user % 4 == 0) | ((user % 10 == 9) & (F.col("event_id") % 2 == 0)))
        cases = " ".join(f"WHEN '{event}' THEN '{name}'" for event, name in EVENT_VARIABLES.items())
        variable = F.expr(f"CASE event_type {cases} END")
        return self.events().select(
            user.alias("sensor_id"), variable.alias("variable"), F.col("ts").alias("time"),
            F.when(gas & (user % 4 == 0), F.col("value") / 1000).otherwise(F.col("value")).alias("value"),
            F.when(in_ppm, "ppm").otherwise("µg/m³").alias("unit"))

    def sensors(self) -> DataFrame:
        user = F.col("user_id")
        latitude, longitude = _home(location_number(user))
        day = F.expr("make_dt_interval(1)")
        return self.events().select("user_id").distinct().select(
            user.alias("sensor_id"),
            (latitude + (F.pmod(user * 7, F.lit(201)) - 100) / 100 * 1.2).alias("latitude"),
            (longitude + (F.pmod(user * 11, F.lit(201)) - 100) / 100 * 1.2).alias("longitude"),
            F.when(user % 3 == 0, "low-cost sensor").otherwise(REFERENCE_GRADE).alias("sensor_type"),
            (F.lit("2023-12-20").cast("timestamp") + day * (user % 30)).alias("first_updated"),
            (F.lit("2024-01-10").cast("timestamp") + day * ((user * 13) % 35)).alias("last_updated"))

    def sensor_variables(self) -> DataFrame:
        """Sensors times the pollutants they have readings of."""
        pairs = self.measurements().select("sensor_id", "variable").distinct()
        return pairs.join(self.sensors(), "sensor_id")

    def catalogue(self) -> DataFrame:
        """Sensors with the nested ``parameters`` and ``sources`` of a catalogue file."""
        m = self.measurements()
        per_variable = m.groupBy("sensor_id", "variable").agg(
            F.count("*").alias("count"), F.avg("value").alias("average"), F.max_by("value", "time").alias("lastValue"),
            F.min("unit").alias("unit"), F.max("time").alias("lastUpdated"), F.min("time").alias("firstUpdated"))
        parameter = F.struct(
            F.col("sensor_id").alias("id"), "unit", "count", "average", "lastValue", F.col("variable").alias("parameter"),
            F.upper("variable").alias("displayName"), "lastUpdated", F.length("variable").alias("parameterId"), "firstUpdated")
        # at most five parameters per sensor
        nested = per_variable.groupBy("sensor_id").agg(
            F.collect_list(parameter).alias("parameters"), F.sum("count").alias("measurements"))
        user = F.col("sensor_id")
        return nested.join(self.sensors(), "sensor_id").select(
            user.alias("id"), _station("city", location_number(user)).alias("city"),
            F.concat(F.lit("sensor "), user.cast("string")).alias("name"), F.lit("government").alias("entity"),
            _station("country", location_number(user)).alias("country"),
            F.array(F.struct(user.cast("string").alias("id"), F.lit("").alias("url"), F.lit("network").alias("name"))).alias("sources"),
            F.lit(False).alias("isMobile"), F.lit(False).alias("isAnalysis"), "parameters",
            F.col("sensor_type").alias("sensorType"), F.col("last_updated").alias("lastUpdated"),
            F.col("first_updated").alias("firstUpdated"), "measurements",
            F.struct("latitude", "longitude").alias("coordinates"))

    def forecast(self) -> DataFrame:
        """Three-hourly forecast per location, wide, from the mean and sum of its readings."""
        bins = (self.events()
                .groupBy(location_number(F.col("user_id")).alias("k"),
                         F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 10800) * 10800).alias("time"))
                .agg(F.avg("value").alias("v"), F.sum("value").alias("sv")))
        # eight bins a day at most
        day = Window.partitionBy("k", F.to_date("time")).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
        fields = {"blh": "100 + v", "d2m": "270 + v / 10", "dsrp": "run * 1000", "go3": "v * 1e-9",
                  "msl": "100000 + v * 10", "no2": "v * 1e-10", "pm10": "v * 2e-10", "pm2p5": "v * 1e-9",
                  "so2": "v * 1e-11", "t2m": "273.15D + v / 10", "tcc": "least(1D, v / 100)", "tp": "run / 100000",
                  "u10": "v / 10 - 5", "uvb": "run * 100", "v10": "5 - v / 10", "z": "5000 + v"}
        return (bins.select(_location_id(F.col("k")).alias("location_id"), "time", "v", F.sum("sv").over(day).alias("run"))
                .selectExpr("location_id", "time", *[f"{fields[f]} AS {f}" for f in RAW_FIELDS]))

    def grid_forecast(self) -> DataFrame:
        """Long gridded forecast on 1-degree cells: each location's values on its cell and three neighbours."""
        home = self.locations().select("location_id", F.round("latitude").alias("lat0"),
                                       F.pmod(F.round("longitude"), F.lit(360.0)).alias("lon0"))
        corners = F.expr("explode(array(struct(0D AS i, 0D AS j), struct(0D AS i, 1D AS j), "
                         "struct(1D AS i, 0D AS j), struct(1D AS i, 1D AS j)))").alias("at")
        return (self.forecast().unpivot(["location_id", "time"], RAW_FIELDS, "variable", "value")
                .join(home, "location_id").select("*", corners)
                .groupBy((F.col("lat0") + F.col("at.i")).alias("latitude"),
                         F.pmod(F.col("lon0") + F.col("at.j"), F.lit(360.0)).alias("longitude"), "time", "variable")
                .agg(F.avg(F.col("value") * (1 + F.col("at.i") * 0.1 + F.col("at.j") * 0.05)).alias("value"))
                .withColumns({"init_date": F.date_format("time", "yyyyMMdd"), "lead_h": F.hour("time")}))

    def run_hours(self, processed: DataFrame, n_future: int = 24) -> DataFrame:
        """The hours of every run (``at``, seconds) with the bias one day earlier: what the predictions of all members come from."""
        target = shift_hours(F.col("time"), 24)
        latest = F.floor(F.unix_timestamp(target) / 43200) * 43200
        inits = F.transform(F.sequence(F.lit(0), F.lit((n_future - 1) // 12)), lambda i: latest - i * 43200)
        rows = (processed.select(*SERIES, F.unix_timestamp(target).alias("at"), "bias", F.explode(inits).alias("init"))
                .withColumn("horizon", F.floor((F.col("at") - F.col("init")) / 3600).cast("int"))
                .where(F.col("horizon").between(0, n_future - 1))
                .withColumn("init_time", F.timestamp_seconds("init")))
        runs = with_rank(rows.select(*SERIES, "init_time").distinct(), SERIES, "init_time")
        split = F.when(F.col("_rank") <= F.floor(F.col("_total") * 0.8), "train").otherwise("test")
        runs = runs.select(*SERIES, "init_time", split.alias("split"))
        return rows.join(runs, [*SERIES, "init_time"]).select(*SERIES, "split", "init_time", "horizon", "at", "bias")

    def predictions(self, processed: DataFrame, members: int = 5, n_future: int = 24) -> DataFrame:
        """Long predictions of five members: the bias one day earlier, scaled by 0.8 .. 1.2."""
        return member_biases(self.run_hours(processed, n_future), members).select(*SERIES, "split", "member", "init_time", "horizon", "bias_hat")
