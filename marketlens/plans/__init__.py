"""Composed analyses: tables in, tables out."""
