"""The same operators over a stream of sequence files."""
