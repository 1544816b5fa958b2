"""Sources of code bases."""
