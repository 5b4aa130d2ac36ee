"""Column expressions: missing values, calendar, physics, regions, chemistry."""
