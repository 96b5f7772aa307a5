"""Public-record analytics as Spark plans."""
