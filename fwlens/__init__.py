"""Firewall-log forensics as Spark DataFrame operators."""
