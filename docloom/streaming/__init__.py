"""Change-stream operators, in batch and streaming form."""
