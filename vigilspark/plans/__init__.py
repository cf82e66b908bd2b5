"""Registered queries over deterministic projections of the testdata, and their SQL oracles."""
