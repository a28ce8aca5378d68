"""Operators for preparing large text corpora for model training.

Nothing outside this subpackage imports it. ``registry`` holds the queries and
the SQL that ``__spark_entry__`` adds when the subpackage is present.
"""
