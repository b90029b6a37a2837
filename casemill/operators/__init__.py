"""Part of casemill: operators."""
