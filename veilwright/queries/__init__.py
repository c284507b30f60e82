"""Queries over the supplied tables, one module per group of operators."""

from . import anonymize, attack, fused, profile, risk, streaming, synthetic  # noqa: F401
