"""Column functions: no function here reads data or triggers a job."""
