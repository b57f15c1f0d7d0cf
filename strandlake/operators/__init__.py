"""Relational operators over reads, modified positions, bit vectors and structures."""
