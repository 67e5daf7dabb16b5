"""Text safety at scale on Spark: scan, redact, gate, retain and audit text tables."""

from textwarden.policy import Policy, StoragePolicy

__all__ = ["Policy", "StoragePolicy"]
