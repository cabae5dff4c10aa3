"""DataFrame operators: arbitration, roll-ups, tree queries, paging and graph."""
