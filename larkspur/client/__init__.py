"""Connections: embedded, over the network, and a command line."""
