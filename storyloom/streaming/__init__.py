"""Progress streams, rate limits and caches as keyed state."""
