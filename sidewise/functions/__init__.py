"""Functions on columns and small driver-side values."""
