"""Operators for preparing training text: packing, sharding, scoring, filtering, privacy, joins and mixing.

Nothing else in the library imports this package.
"""
