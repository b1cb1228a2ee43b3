"""Days that grow: recordings appended as they come, and running channel summaries."""
