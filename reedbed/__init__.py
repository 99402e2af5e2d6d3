"""Set-based Spark jobs for research-reading communities."""
