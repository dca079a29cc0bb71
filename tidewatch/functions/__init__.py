"""Column builders: scalars, rules, wide integers."""
