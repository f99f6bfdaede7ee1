"""Part of the presswork engine."""
