"""Aggregate functions of the operator layer."""
