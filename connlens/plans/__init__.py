"""Views over the given tables, the query catalogue and its SQL twins."""
