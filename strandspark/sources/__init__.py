"""Readers and writers of genomic text and binary formats."""
