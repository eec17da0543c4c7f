"""Readers, adapters over the driver tables, sinks and contract checks."""
