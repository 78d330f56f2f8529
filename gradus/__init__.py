"""gradus: raw tables to trusted predictions, as Spark DataFrame functions.

Subpackages
-----------
functions   column expressions (names, lenient casts, hashing, model scores)
sources     reading, writing and listing tables
operators   DataFrame -> DataFrame building blocks
plans       whole flows put together from the operators
checks      the same operators bound to the test tables, each with its SQL oracle
"""
