"""Readers with explicit schemas; what they cannot read becomes a row of diagnostics."""
