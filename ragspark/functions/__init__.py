"""Column functions and small helpers the operators share."""
