"""Readers with their contract checks, and writers."""
