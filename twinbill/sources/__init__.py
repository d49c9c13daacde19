"""Readers, writers and the labelled ledger derivation."""
