"""Churn risk on Spark: canonical customer tables, survival scores, support signals, ranked reports."""
