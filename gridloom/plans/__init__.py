"""Driver-side plans: SQL sandbox and its guard, prompts, agent and pipeline."""
