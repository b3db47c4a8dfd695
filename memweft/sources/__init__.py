"""Sources: Markdown directories and the recall log."""
