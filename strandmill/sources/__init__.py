"""Readers of sequencing data and of tables that stand in for it."""
