"""The typed text notation, the transform language and its compiler."""
