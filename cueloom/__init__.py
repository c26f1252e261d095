"""Timed-text analytics as DataFrame operators."""
