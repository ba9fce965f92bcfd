"""Schema matching, validation and writers."""
