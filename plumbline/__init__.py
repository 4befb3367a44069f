"""plumbline: DataFrame operators for timestamped, tracked and geometric data."""
