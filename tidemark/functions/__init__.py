"""Column functions: fixed point numbers, instants, hashes."""
