"""Part of casemill: sources."""
