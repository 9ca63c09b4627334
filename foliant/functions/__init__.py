"""Column-building functions: text analysis, ranges, replacements, formats."""
