"""Named queries: each applies operators to the driver's tables, with SQL that says the same."""
