"""Tables and files as series."""
