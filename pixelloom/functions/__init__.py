"""Part of pixelloom; see the package docstring."""
