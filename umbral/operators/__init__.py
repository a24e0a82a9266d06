"""Catalogs, partitioners, padding, and the selections and joins built on them."""
