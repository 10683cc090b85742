"""Where rows come from: file trees, ignore rules, configuration, path aliases, evaluation sets, watched folders."""
