"""Chains of operators, and the registry of queries."""
