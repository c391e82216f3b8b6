"""Models: one aggregation job a pass, small dense solves on the driver."""
