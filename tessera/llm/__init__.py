"""Training-data operators: each module holds one operator, `catalogue` its queries."""
