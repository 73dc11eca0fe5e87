"""Part of vecloom: operators."""
