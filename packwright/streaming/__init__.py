"""Quality counts over unbounded tables."""
