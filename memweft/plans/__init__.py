"""Multi-operator plans: index build, batch recall, and the query registry."""
