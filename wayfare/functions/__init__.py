"""Column expressions. All run inside the JVM except ``fold_accents`` and model encoders."""
