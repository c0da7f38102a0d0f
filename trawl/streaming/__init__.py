"""Empty on purpose: none of the operators that this library covers works on a stream, and all of them are deterministic over a fixed corpus."""
