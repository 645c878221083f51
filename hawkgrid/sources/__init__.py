"""Readers for event logs, packet tables, labelled sets and the driver's fixture tables."""
