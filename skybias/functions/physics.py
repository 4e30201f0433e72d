"""Unit conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------
MOLES_PER_LITRE = 0.0409
MOLAR_MASS = {"o3": 48.00, "no2": 46.01}
LAPSE_RATE = -0.0065
GRAVITY = 9.80665
AIR_MOLAR_MASS = 0.0289644
GAS_CONSTANT = 8.31432
DRY_AIR_CONSTANT = 287.058
# ----------------------------------------------------------------------------------------------
BAROMETRIC_EXPONENT = GRAVITY * AIR_MOLAR_MASS / (GAS_CONSTANT * -LAPSE_RATE)


def ppm_to_ugm3(value: Column, unit: Column, variable: Column) -> Column:
    """Readings in ppm to microgram / m^3, row by row. Particulate readings in ppm are an error."""
    in_ppm = unit == "ppm"
    out = F.when(in_ppm & (variable == "pm25"),
                 F.raise_error(F.lit("pm25 readings are in ppm")).cast("double"))
    for gas, mass in MOLAR_MASS.items():
        out = out.when(in_ppm & (variable == gas), value * (MOLES_PER_LITRE * mass * 1e3))
    return out.otherwise(value)


def converted_unit(unit: Column, variable: Column) -> Column:
    return F.when(variable.isin(list(MOLAR_MASS)) & (unit == "ppm"), F.lit("µg/m³")).otherwise(unit)


def surface_pressure(msl: Column, t2m: Column, elevation: Column) -> Column:
    """Pressure at the station from mean sea level pressure (Pa), temperature (K), elevation (m)."""
    return msl * F.pow(1 + F.try_divide(F.lit(LAPSE_RATE), t2m) * elevation, F.lit(BAROMETRIC_EXPONENT))


def air_density(pressure: Column, t2m: Column) -> Column:
    return F.try_divide(pressure, t2m * DRY_AIR_CONSTANT)


def mixing_ratio_to_ugm3(value: Column, density: Column) -> Column:
    """kg/kg to microgram / m^3."""
    return value * density * 1e9
