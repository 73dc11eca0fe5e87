"""Part of vecloom: streaming."""
