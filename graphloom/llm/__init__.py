"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage.  Each operator lives in a
module of its own with a general interface; the thin ``opN_<name>(spark,
sf_dir)`` queries that apply it with production parameters are collected in
:mod:`graphloom.llm.registry`.
"""
