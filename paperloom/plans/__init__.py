"""Ready-made query plans over the driver's tables."""
