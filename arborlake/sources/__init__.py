"""Readers that turn listings, watch logs and catalogues into engine tables."""
