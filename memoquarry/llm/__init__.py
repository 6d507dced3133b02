"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it.  Every module holds one operator;
``registry`` holds the queries that apply them to the standard tables.
"""
