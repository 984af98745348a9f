"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  Every operator takes and returns DataFrames; the thin
``opN_<name>`` queries over the fixture tables are in :mod:`studyflow.llm.queries`.
"""
