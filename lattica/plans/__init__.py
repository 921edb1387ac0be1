"""Orchestration of whole splits."""
