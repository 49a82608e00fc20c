"""DataFrame operators: joins, rankings, searches, traversals and snapshot changes."""
