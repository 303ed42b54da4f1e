"""Column expressions and pure Python helpers shared by the operators."""
