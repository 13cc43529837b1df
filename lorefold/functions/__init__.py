"""Part of lorefold."""
