"""Validation of streams, which goes beyond batch parity: constraints on single values, as rows arrive."""
