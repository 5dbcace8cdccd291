"""Readers, calendars and data contracts at the source."""
