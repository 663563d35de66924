"""Readers of packets, calibrations, transforms and registers."""
