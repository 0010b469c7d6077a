"""Training-data operators: each module has a general operator and its ``opN`` query."""
