"""Part of vecloom: sources."""
