"""Analytic plans over member, period and group tables."""
