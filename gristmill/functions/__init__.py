"""Column expressions and small numeric functions shared by the operators."""
