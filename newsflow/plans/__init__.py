"""End-to-end jobs and the query catalogue wired over the supplied tables."""
