"""Column expressions: text folding, unit parsing, verdict and outcome builders."""
