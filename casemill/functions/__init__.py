"""Part of casemill: functions."""
