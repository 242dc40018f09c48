"""Column functions: pure Column -> Column expressions that stay inside code generation."""
