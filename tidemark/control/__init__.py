"""The control plane: small records on the driver. Nothing here needs Spark."""
