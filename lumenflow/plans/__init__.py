"""Reusable plan shapes: prefix scans, hops, interval lookups, ordered state."""
