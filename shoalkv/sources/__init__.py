"""Where rows come from and go: the framed log, and the lake of published files."""
