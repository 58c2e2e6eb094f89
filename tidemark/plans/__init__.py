"""Whole analyses: from observations to result tables, and from these to what dashboards show."""
