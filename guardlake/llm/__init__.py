"""Training-data operators. Nothing else in guardlake imports this subpackage."""
