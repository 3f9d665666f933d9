"""Readers and writers for the tables and documents the operators work on."""
