"""Whole jobs built from the operators, the test bindings and their SQL equivalents."""
