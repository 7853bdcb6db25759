"""Readers, writers and binders from raw tables to the engine's schemas."""
