"""Column functions: geodesy, units, clocks, order statistics."""
