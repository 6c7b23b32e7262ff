"""Registered queries, each with its SQL twin."""
