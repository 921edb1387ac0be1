"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Every operator works on a
DataFrame of texts, reads whole texts, keeps rows whole and has a defined
result for nulls, empty texts, repeated rows and empty tables.
"""
