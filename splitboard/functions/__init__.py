"""Column expressions. None of them runs Python on the executors."""
