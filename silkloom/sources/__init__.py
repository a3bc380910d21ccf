"""Sources of sequences: FASTA and FASTQ files (plain or gzip), pairs of files, tables."""
