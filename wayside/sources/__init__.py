"""Readers of staged files and writers of staging tables, facts and extracts."""
