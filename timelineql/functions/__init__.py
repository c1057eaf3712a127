"""Functions over codes, code books and pattern strings."""
