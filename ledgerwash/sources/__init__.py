"""Schemas, readers, the TESTDATA-derived fixture, catalog and sinks."""
