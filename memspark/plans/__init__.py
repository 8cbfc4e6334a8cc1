"""Entity views over input tables."""
