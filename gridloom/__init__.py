"""Gridloom: turns messy files into catalogued tables and answers questions about them, on Spark."""
