"""Resampling statistics on ensembles of indexed measurements, as PySpark DataFrame operators."""
