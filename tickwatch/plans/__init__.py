"""Whole evaluations: from log rows and rules to every derived table."""
