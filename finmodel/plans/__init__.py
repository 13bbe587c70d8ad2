"""From graphs to plans: compiled columns, strategies, compiler passes."""
