"""Readers that turn files into cells, pages, rows and log records."""
