"""Event queries as Spark jobs: a catalog of event types, queries over it, and ready-made views."""
