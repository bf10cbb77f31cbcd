"""One module for each query."""
