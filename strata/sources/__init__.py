"""Readers of collector dumps and result files, and writers of reports."""
