"""corpusmill: reasoning-corpus preparation and auditing as Spark jobs.

Every operator is a function from DataFrame (or Column) to DataFrame (or
Column); the physical plan is Catalyst's.  See README.md for the map from
operator ids (A1..I4) to functions.
"""

__version__ = "0.1.0"
