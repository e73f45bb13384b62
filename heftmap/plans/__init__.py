"""Dry-run plans: what a change would touch and save, computed without changing anything."""
