"""Burn severity and vegetation impact as Spark DataFrame operators."""
