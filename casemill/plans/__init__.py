"""Part of casemill: plans."""
