"""Part of vecloom: functions."""
