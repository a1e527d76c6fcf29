"""Spark-first processing of short sequencing reads: sources, column functions, operators, quality assessment."""
