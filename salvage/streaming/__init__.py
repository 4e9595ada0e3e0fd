"""The stateless operators on a stream."""
