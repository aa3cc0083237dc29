"""Sensor time-series analytics for many entities, written as Spark plans."""
