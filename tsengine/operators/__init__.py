"""Operators on panels, windows, forecasts and run logs."""
