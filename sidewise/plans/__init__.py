"""Searches that combine counts of rows with a small tree on the driver, and the query catalog."""
