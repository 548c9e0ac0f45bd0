"""Named query plans over the driver tables, with their DuckDB oracle texts."""
