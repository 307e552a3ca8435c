"""Readers and writers: tables, CSV, gateway payloads, event streams, reports."""
