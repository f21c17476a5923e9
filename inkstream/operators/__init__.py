"""Archive operators: order, scopes, queue, statistics, scheduling, merging, snapshots."""
