"""Relational operators over panels, detections, text regions and graphs."""
