"""Multi-operator plans: panel build, feature blocks, projection, record, evaluation."""
