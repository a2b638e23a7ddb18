"""DataFrame -> DataFrame operators grouped by concern."""
