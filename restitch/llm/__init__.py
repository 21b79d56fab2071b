"""Operators for preparing training data at scale. Nothing else in the package imports this folder.

Operators that keep or judge documents return the input row whole, as the struct `row`,
beside their own columns; so no column name of the input can clash with theirs.
"""
