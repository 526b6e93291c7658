"""Model selection: comparing imputers over artificial holes, and tuning them; and the query catalogue."""
