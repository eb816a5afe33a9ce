"""Column builders: geometry of boxes and points, and text rules."""
