"""Rule dictionaries as data. Operators take them as parameters; these are the defaults."""
