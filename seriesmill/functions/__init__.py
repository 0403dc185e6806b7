"""Functions of single values, labels and dates."""
