"""Cohort building and feature engineering for event data, on Spark DataFrames."""

from admitflow.params import Params
from admitflow.session import local_session, tune

__all__ = ["Params", "local_session", "tune"]
