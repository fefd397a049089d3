"""Part of the rollout analytics engine."""
