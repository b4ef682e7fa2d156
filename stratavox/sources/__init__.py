"""Table adapters, point-cloud files and messages, publishing."""
