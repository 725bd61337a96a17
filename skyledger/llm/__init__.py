"""Operators of a training-data pipeline.

Each module is one operator; ``queries`` registers one query per operator and
``corpus_pipeline.py`` at the top of the repository chains five of them.
Nothing else in the library imports this subpackage.
"""
