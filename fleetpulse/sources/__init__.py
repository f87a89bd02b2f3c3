"""Readers, writers and table mixes."""
