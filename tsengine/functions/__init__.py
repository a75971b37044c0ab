"""Column expressions: calendar, encodings, numeric and text helpers."""
