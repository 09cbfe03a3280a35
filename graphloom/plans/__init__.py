"""Building blocks shared by the operators: shared scratch tables and iteration."""
