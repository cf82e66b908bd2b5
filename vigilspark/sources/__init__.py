"""Readers: files, rule-engine output, event logs, reports, run folders, facts."""
