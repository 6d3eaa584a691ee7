"""Readers for logs, alerts and block lists, and the synthetic event generator."""
