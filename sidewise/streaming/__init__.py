"""Upkeep of counts over streams."""
