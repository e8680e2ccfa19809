"""Plans that combine several operators."""
