"""Part of helixmill; see README.md."""
