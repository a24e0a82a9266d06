"""Readers and writers of tables, workloads, bins and indexes."""
