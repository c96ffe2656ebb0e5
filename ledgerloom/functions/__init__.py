"""ledgerloom.functions."""
