"""Tracewright: trace, dataflow-graph, scope and energy analytics as PySpark plans."""
