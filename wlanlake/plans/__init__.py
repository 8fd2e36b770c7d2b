"""Jobs that chain several operators: preparation, training, evaluation."""
