"""Part of guardlake."""
