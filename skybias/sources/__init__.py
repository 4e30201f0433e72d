"""Readers, writers and the views of the driver's tables as domain tables."""
