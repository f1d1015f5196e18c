"""Column functions: vectors, paths and signatures."""
