"""Readers and writers of the formats that pass between stages."""
