"""Readers and writers: driver tables, exported experiment sheets, survey and tracked CSV, plate grids, Parquet sink."""
