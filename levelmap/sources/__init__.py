"""Where ticks, bars and level sheets come from, and where results go."""
