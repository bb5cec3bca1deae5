"""Operators of the prose engine: context, scans, rules, waivers, scores and project checks."""
