"""Reading dumps, tables and the test fixtures; staging of intermediate tables."""
