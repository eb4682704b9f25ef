"""Column functions and Arrow functions on strings."""
