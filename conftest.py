"""Makes the repository's root importable for the tests."""
