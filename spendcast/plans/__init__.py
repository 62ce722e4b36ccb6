"""Composites a user calls: baseline, feature matrices, models, tuning, jobs."""
