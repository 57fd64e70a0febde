"""Where rows come from: source trees, git, files of text, and what is extracted from source."""
