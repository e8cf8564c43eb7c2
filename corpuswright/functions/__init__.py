"""Column-level building blocks; none of them triggers a job."""
