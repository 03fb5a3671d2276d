"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; ``queries`` and ``oracle_sql`` in
:mod:`weftgraph.llm.entry` are what the driver entry adds when it is present.
"""
