"""Operators for building language-model training data.

Nothing outside this subpackage imports it. The operators keep general
interfaces; `queries` holds the thin contract queries built on them.
"""
