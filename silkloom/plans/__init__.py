"""How plans are cut and sized: shared storage, partition counts and size checks."""
