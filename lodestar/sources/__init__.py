"""Readers and writers of files, messages and tables."""
