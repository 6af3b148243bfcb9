"""Queries over the driver's tables and the plain SQL they are checked against."""
