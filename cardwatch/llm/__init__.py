"""Operators for preparing training data: packing, search, deduplication, scoring, privacy.

Every operator is a function from DataFrame to DataFrame. Nothing else in the library imports this
package; ``queries.py`` holds the registered queries.
"""
