"""DataFrame operators on panels, images and selections."""
