"""Column expressions and Arrow functions shared by the operators."""
