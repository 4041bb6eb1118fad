"""Operators for large training-data pipelines.

Nothing outside this package imports it; ``lectern.llm.registry`` lists its
queries and their SQL for the driver's entry module.
"""
