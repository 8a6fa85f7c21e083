"""Column functions: text normal forms, token sets, similarities and quality measures."""
