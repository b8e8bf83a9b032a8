"""Continuous forms of the batch queries. They go beyond batch parity and are optional."""
