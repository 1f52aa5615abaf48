"""Functions on columns and numbers."""
