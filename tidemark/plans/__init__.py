"""Driver-side planning: archive lists, rules, configuration and the choice of an archive."""
