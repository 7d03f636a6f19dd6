"""Plan helpers: written intermediates and connected components."""
