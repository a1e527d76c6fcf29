"""Operators on tables of reads, alignments and intervals."""
