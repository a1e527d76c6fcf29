"""Incremental reading of sequencing files."""
