"""Relational, panel, conformal and metric operators."""
