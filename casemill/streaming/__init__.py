"""Part of casemill: streaming."""
