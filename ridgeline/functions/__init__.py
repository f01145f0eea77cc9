"""Column expressions: grid, hazard, building and tile arithmetic.  All stay inside whole-stage code generation."""
