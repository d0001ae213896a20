"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each operator lives in its own
module; ``queries`` binds them to the project's tables.
"""
