"""End-to-end dataflows and the query catalog."""
