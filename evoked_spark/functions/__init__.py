"""Column functions over sample arrays and event codes."""
