"""Scalar functions: Column expressions, and parsers for the few things SQL cannot express."""
