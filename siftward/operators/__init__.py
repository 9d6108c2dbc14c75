"""DataFrame operators: the steps that group, join or window."""
