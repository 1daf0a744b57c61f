"""Relational operators that the lowered programs are made of."""
