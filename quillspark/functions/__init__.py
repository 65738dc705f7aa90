"""Row rules as column expressions."""
