"""Named queries: operators applied to the fixture views, each with its SQL."""
