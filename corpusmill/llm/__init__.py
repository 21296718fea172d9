"""Operators of a training-data pipeline at corpus scale.

Nothing else in the library imports this subpackage.  ``catalog`` registers
one query ``opN_<name>`` per operator; the operators themselves live in one
module each and take and return DataFrames.
"""
