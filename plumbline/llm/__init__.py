"""Training-data operators over documents and pages. Nothing else in the library imports this package."""
