"""The queries checked against SQL, their inputs, and that SQL."""
