"""Spark-first engine for building, auditing and querying citable text evidence.

Subpackages
-----------
functions   Column -> Column building blocks (text folds, overlap, vectors, rules)
operators   DataFrame -> DataFrame relational operators
sources     typed readers, writers and snapshot swaps
plans       the query catalogue: one callable and one oracle SQL per query
streaming   Structured Streaming wrappers around the incremental operators
"""
