"""Column functions: assemblies and contigs, alleles, identifiers, HGVS notation."""
