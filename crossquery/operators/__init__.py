"""Plan fragments as DataFrame transformations."""
