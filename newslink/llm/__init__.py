"""Training-data operators: each module holds one operator for large document tables."""
