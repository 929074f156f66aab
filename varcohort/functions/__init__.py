"""Column expressions over variants, genotypes and annotations; all of them stay in the JVM."""
