"""Reading vendor files and writing tables."""
