"""Physical-plan building blocks: staged tables, size-checked joins, distributed ordering."""
