"""Makes the repository importable in tests."""
