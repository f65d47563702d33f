"""Reading and writing of volumes, listings, manifests and tables."""
