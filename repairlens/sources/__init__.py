"""Readers and writers of the artefacts that code-repair runs leave."""
