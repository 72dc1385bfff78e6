"""Operators for building language-model training data.

Nothing else in the library imports this subpackage.  ``registry`` lists the
queries; every other module holds one operator with its own general interface.
"""
