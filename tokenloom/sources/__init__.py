"""Scans: driver tables, fixed dimension tables and derived inputs."""
