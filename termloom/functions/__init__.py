"""Column functions: rules, text, numbers, calendar."""
