"""Whole flows, and the skew-safe building blocks they share."""
