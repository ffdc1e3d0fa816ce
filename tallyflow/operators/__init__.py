"""DataFrame operators: projection, sampling, preparation, models, evaluation, search."""
