"""Relational analytics over document figures: boxes, text regions, reaction graphs."""
