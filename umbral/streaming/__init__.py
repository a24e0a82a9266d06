"""Replaying workloads as they arrive."""
