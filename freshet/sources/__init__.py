"""Panels, envelopes and stored images."""
