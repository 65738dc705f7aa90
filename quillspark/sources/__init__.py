"""Tables in and tables out."""
