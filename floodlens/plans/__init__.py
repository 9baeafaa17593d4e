"""Input views and the query registry."""
