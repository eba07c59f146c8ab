"""Spark-first analytics over sensor events, sequences, trajectories and road graphs."""
