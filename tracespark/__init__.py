"""Trace analytics on PySpark: raw socket events to spans, trace queries, rollups, anomalies."""
