"""Training-data operators: each module holds one operator and runs on its own."""
