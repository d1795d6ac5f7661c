"""Registered queries: operators applied to tables of a data folder, with their SQL."""
