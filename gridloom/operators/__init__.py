"""gridloom.operators."""
