"""Packet-capture analytics and text-corpus preparation as Spark jobs."""
