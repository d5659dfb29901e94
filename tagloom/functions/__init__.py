"""Column functions over sequences, positions and estimates."""
