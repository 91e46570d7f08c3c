"""Extensions beyond the batch operators: the same analytics over streams."""
