"""Rollout analytics expressed as Spark DataFrame plans."""
