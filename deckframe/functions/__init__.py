"""Column functions: boxes, colours and statistics."""
