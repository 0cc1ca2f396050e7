"""terrastat: territorial incidence analytics as Spark DataFrame jobs.

Every operator is a function from DataFrames to DataFrames (or to a small
dataclass of lazy DataFrames) expressed with the Spark SQL / ML APIs so that
Catalyst plans it and the cluster runs it. See README.md for the map from the
survey's operator ids to modules.
"""

__version__ = "0.1.0"
