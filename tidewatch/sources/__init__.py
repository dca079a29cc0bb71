"""Tables, roles and log sources."""
