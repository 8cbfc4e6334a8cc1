"""Column functions: text, time, hashing, vectors, privacy and pages."""
