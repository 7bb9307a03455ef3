"""CSV input, event and customer tables, model storage."""
