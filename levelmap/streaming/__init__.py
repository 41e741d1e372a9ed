"""The live path: ticks to confirmed bars to alerts, and a view of the forming bar."""
