"""Reading and writing tables, archives and records of provenance."""
