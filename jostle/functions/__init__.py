"""Column functions: outcome codes, score descriptors, the counter-based random numbers, hashing."""
