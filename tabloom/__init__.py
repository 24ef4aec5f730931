"""tabloom: feature-data jobs written as Spark DataFrame functions."""
