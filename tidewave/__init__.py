"""Swing-structure analytics on Spark: bars, waves, zones and trades as DataFrame queries."""
