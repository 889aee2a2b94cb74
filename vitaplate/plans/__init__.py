"""Surrogate inputs, the named query catalogue, its SQL oracle, output shaping and export workflows."""
