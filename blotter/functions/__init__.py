"""Scalar column functions and fixed lookup values."""

from blotter.functions import fixed, temporal  # noqa: F401
