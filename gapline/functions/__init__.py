"""Column expressions only; nothing here triggers a job."""
