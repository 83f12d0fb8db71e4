"""Generic DataFrame operators (survey sections 2.B-2.I)."""
