"""Sinks that commit: several keyed tables at once, by buckets and deltas."""
