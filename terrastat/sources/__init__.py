"""Sources and sinks: parquet/CSV readers with explicit schemas, writers, and
the incidence / municipality / mart views derived from the star schema."""

from terrastat.sources.tables import read_table  # noqa: F401
