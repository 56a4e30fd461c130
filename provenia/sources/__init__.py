"""Where pages, truth, metadata and prices come from."""
