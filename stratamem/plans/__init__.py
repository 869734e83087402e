"""Named queries over a data directory, with the SQL that states the same result."""
