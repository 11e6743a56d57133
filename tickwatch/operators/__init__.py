"""Operators: search, state, metrics, series alerts, notifications, catalog quality."""
