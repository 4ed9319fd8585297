"""Value conversions and privacy functions."""
