"""Audits and reports: several operators over shared inputs."""
