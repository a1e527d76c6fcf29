"""Compositions: quality assessment, reports and the registered queries."""
