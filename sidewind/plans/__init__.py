"""Named queries, feature matrices, serving frames and the step runner."""
