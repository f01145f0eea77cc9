"""Tables, layers and files that the operators read."""
