"""Column functions: text, time, geography, vectors, hashes."""
