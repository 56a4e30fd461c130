"""Evidence-first document extraction on Spark."""
