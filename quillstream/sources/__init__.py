"""Reading raw and wire events, and reading and writing the tables."""
