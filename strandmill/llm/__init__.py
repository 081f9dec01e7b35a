"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage; ``__spark_entry__.py``
registers its queries only when it can be imported.
"""
