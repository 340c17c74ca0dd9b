"""Queries over the star tables: each pairs a library call with the SQL it must agree with."""
