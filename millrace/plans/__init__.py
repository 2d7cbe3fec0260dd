"""Query registry; importing the modules registers their queries."""
