"""Operators on panels (station, date, value): one row a station and day, so a station's group is bounded by the calendar."""
