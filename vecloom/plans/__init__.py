"""Part of vecloom: plans."""
