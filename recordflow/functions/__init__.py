"""Column functions with the language's scalar semantics.

Kinds of values: N (number, a double column), S (text), F (text from input, a number
where it looks like one), U (unset).
"""
