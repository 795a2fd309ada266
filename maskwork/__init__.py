"""Detection and redaction of sensitive data on Spark, as DataFrame functions."""
