"""See the package docstring and the README for what lives here."""
