"""gridloom.streaming."""
