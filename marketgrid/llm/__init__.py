"""Operators for preparing large text collections for model training.

One module per operator; ``queries.py`` registers one query per operator and
the pipeline.  Nothing else in the library imports this package.
"""
