"""Query text, rules, scopes and plans, worked out on the driver."""
