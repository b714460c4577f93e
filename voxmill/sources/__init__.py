"""Readers and writers of requests, records, results and model tables."""
