"""abspark: A/B-experiment analysis on Spark DataFrames."""

from abspark.plans.analyze import analyze, analyze_all
from abspark.plans.report import build_report, run_report
from abspark.session import build_session

__all__ = ["analyze", "analyze_all", "build_report", "build_session", "run_report"]
