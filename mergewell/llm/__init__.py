"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames; the
queries registered for the driver live in :mod:`mergewell.llm.queries`.
"""
