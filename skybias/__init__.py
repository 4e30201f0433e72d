"""Bias correction of gridded air-quality forecasts as lazy Spark DataFrame operators."""

from skybias.session import build_session, tune

__all__ = ["build_session", "tune"]
