"""casemill: audited analytics over case records, expressed as lazy Spark DataFrame operators."""
