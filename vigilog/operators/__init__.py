"""Operators on unified logs, feature windows and alerts."""
