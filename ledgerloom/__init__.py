"""Ledger graph analytics on Spark."""
