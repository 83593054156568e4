"""Quality rules, cleaning, validation, profiling and distributed ordering."""
