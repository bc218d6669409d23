"""Pure Column functions; they stay inside whole-stage code generation."""
