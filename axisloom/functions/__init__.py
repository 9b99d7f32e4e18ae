"""Part of axisloom; see the README."""
