"""The pattern-action language: text to syntax tree."""
