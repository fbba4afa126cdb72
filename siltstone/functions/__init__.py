"""Column functions: text, paths, severities, quality arithmetic."""
