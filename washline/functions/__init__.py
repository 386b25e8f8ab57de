"""Column-level building blocks: typing, statistics and text expressions."""
