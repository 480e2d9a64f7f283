"""Training-data operators: mixing, dedup, scans, classifiers, extraction, sharding, fingerprints.

Nothing else in the library imports this subpackage.
"""
