"""Column expressions shared by the metric tables."""
