"""Scalar building blocks: every helper takes and returns Columns of built-in expressions."""
