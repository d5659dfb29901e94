"""Dataflow operators: digest, screen, anchors, chains, estimators and what is built on them."""
