"""Readers for raw logs, tables and message streams."""
