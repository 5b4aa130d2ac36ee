"""Named data products over the driver tables, and their reference SQL."""
