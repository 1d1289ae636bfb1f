"""Quire: bibliographic records as DataFrames."""
