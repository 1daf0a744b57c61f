"""Values, formats, regular expressions and the sequential evaluator."""
