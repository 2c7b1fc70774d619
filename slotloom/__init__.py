"""Slot corpus engine: paragraph documents kept, searched and revised with Spark."""
