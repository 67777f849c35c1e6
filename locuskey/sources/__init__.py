"""Sources and sinks: VCF text, reference genomes, BGZF."""
