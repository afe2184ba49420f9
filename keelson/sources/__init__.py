"""Where rows come from and go to: remote reads, kept values, an outbox and reconciled targets."""
