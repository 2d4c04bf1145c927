"""Query specifications and the plans made of them."""
