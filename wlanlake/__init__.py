"""wlanlake: wireless-frame security analytics as Spark DataFrame operators."""
