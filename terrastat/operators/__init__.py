"""DataFrame -> DataFrame operators (see README for the id map)."""
