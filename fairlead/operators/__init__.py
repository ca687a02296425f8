"""Operators on DataFrames: joins, tracks, port state, port calls, queues, routes, registers and models."""
